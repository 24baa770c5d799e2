"""Decontamination of documents with several occurrences, of unusual items and of passages from long items."""

from cohortwise.llm import decontaminate

ITEM = "A train leaves the old station with 12 apples and 15 km to go before the night falls over town"


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def pairs(docs, bench):
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}


def test_each_occurrence_is_judged_alone(spark):
    form = ITEM.replace("12", "{}").replace("15", "{}")
    twice = lambda *v: form.format(*v[:2]) + ". " + form.format(*v[2:]) + "."
    docs = table(spark, [(1, twice(12, 15, 3, 4)), (2, twice(3, 4, 5, 6)), (3, "Filler of some words. " * 30 + twice(7, 8, 12, 15)), (4, "x " + twice(3, 4, 3, 4)),
                         (5, twice("1.5", 20, 30, "4.25"))], "doc_id")
    bench = table(spark, [(1, ITEM)], "item_id")
    assert pairs(docs, bench) == {(1, 1): "verbatim", (2, 1): "reparameterised", (3, 1): "verbatim", (4, 1): "reparameterised", (5, 1): "reparameterised"}
    assert decontaminate.clean(docs, bench).count() == 0


def test_every_item_is_indexed(spark):
    sums = "12 + 7, 45 + 19, 3 + 88, 61 + 24, 90 + 5, 17 + 33"
    chinese = "如果一列火车早上出发，中午到达，路上花了多少时间"
    bench = table(spark, [(1, sums), (None, ITEM), (3, "Zebras graze where rivers bend and tall reeds grow by the quiet mill"), (3, "Cobblers mend old boots while the rain drums on the tin roof above"),
                          (4, "Define entropy"), (5, chinese), (6, "...")], "item_id")
    docs = table(spark, [(1, f"Sums: {sums}."), (2, ITEM), (3, "Then cobblers mend old boots while the rain drums on the tin roof above"), (4, "Please define entropy now"),
                         (5, "问题：" + chinese + "。"), (6, "Zebras graze where rivers bend and tall reeds grow by the quiet mill"), (7, "11 + 8, 44 + 20, 2 + 89, 60 + 25, 91 + 4, 16 + 34"), (8, "entropy, define")], "doc_id")
    assert pairs(docs, bench) == dict.fromkeys([(1, 1), (2, None), (3, 3), (4, 4), (5, 5), (6, 3)], "verbatim")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [7, 8]


def test_passages_of_long_items(spark):
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03}") + "o"
    words = [word(k) for k in range(250)]
    words[30], words[36] = "12", "15"
    text = lambda start, n: "Before it. " + " ".join(words[start:start + n]) + " and after"
    bench = table(spark, [(1, " ".join(words)), (2, "they walked along the shore when Maria met Jonas, and Anna told Peter about it, then Clara went home with Oskar again")], "item_id")
    names = bench.where("item_id = 2").first().text
    docs = table(spark, [(1, text(60, 60)), (2, text(100, 13)), (3, text(100, 12)), (4, text(25, 20).replace("12", "3").replace("15", "4")),
                         (5, names.lower()), (6, names.replace(" ", "\n")), (7, " ".join(words[k] for j in range(0, 90, 9) for k in range(j, j + 7)))], "doc_id")
    got = pairs(docs, bench)
    assert got == {(1, 1): "verbatim", (2, 1): "verbatim", (4, 1): "reparameterised", (5, 2): "verbatim", (6, 2): "verbatim"}
