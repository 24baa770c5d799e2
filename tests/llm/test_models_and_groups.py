"""Near duplicates, language model, quality, toxicity, mixing, decontamination, tool calls and the pipeline."""

import collections
import json
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from cohortwise.llm import decontaminate, lm_score, mixing, near_dedup, quality, tool_calls, toxicity
from cohortwise.llm.common import table
from cohortwise.llm.components import components
from cohortwise.shipping import ship

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, component string"
BASE = " ".join(f"w{k}" for k in range(60))
ODD = [(1, None), (2, ""), (3, BASE), (4, BASE.upper() + "\n"), (5, BASE.replace("w59", "other")), (6, "one two"), (7, "One  TWO"), (None, BASE), (8, "x " * 20000), (8, "x " * 20000)]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, None, None, "clash") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(90, 91), (91, 95), (7, 7)], "u bigint, v bigint")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 91: 90, 95: 90}


def test_every_text_of_an_id_is_searched(spark):
    """One id with three texts, and a near copy of each under another id."""
    ship(spark)
    texts = [" ".join(f"{c}{k}" for k in range(80)) for c in "abc"]
    near = [" ".join(t.split()[:-1] + ["other"]) for t in texts]
    rows = [(5, t, None, None, "clash") for t in texts] + [(i, t, None, None, "clash") for i, t in zip((10, 9, 11), near)] + [(20, "x " + texts[0][::-1], None, None, "")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: (5, True), 9: (5, False), 10: (5, False), 11: (5, False), 20: (20, True)}


def near_plain(docs, size, percent):
    sets = {d: frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if (w := (t or "").encode().lower().split()) else frozenset() for d, t in docs}
    least = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[least[d]] == least[d] for d in sets):
            break
    return {d: (len(sets[d]), least[d]) for d in sets}


def test_near_groups(odd, empty, spark):
    want = near_plain([r for r in ODD if r[0] is not None], 5, 80)
    rows = near_dedup.near_groups(odd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want and len(rows) == len(ODD)
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert near_dedup.near_groups(empty).count() == 0
    real = table(spark, SF, "documents")
    want = near_plain([(r.doc_id, r.text) for r in real.collect()], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(real, 3, 85).collect()} == want


def test_language_model(odd, empty):
    got = {(r.doc_id, r.n_tokens): r for r in lm_score.score_rows(odd).collect()}
    assert lm_score.score_rows(empty).count() == 0
    tokens = [(d, [*(t or "").encode().lower().split(), b"\n"]) for d, t in ODD]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    one, two = collections.Counter(), collections.Counter()
    for d, t in tokens:
        if not held(d):
            one.update(t)
            two.update(zip([b"<s>", *t[:-1]], t))
    total, follow, cont = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (x, y), c in two.items():
        total[x] += c
        follow[x][min(c, 3)] += 1
        cont[y] += 1
    counts = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d1, d2, n, v = lm_score.discounts(*counts(cont)), lm_score.discounts(*counts(two)), sum(one.values()), len(one)
    rest = sum(d1[min(c, 3)] for c in cont.values()) / len(two)

    def p(x, y):
        low = max(cont[y] - d1[min(cont[y], 3)], 0) / len(two) + rest / (v + 1)
        return (max(two[x, y] - d2[min(two[x, y], 3)], 0) + sum(d2[k] * follow[x][k] for k in (1, 2, 3)) * low) / total[x] if total[x] else low
    for d, t in tokens:
        row = got[d, len(t)]
        assert math.isclose(row.score, sum(math.log10(p(x, y)) for x, y in zip([b"<s>", *t[:-1]], t)), rel_tol=1e-9)
        assert math.isclose(row.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert (row.train_tokens, row.held_out) == (n, held(d))


def test_larger_vocabularies_than_word_numbers_are_refused(odd, monkeypatch):
    monkeypatch.setattr(lm_score, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="distinct words"):
        lm_score.train(odd)


def test_quality_and_toxicity_agree_with_labels(spark, odd, empty):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    joined = quality.quality_rows(docs).join(labels, "doc_id")
    assert joined.where("kept <> (quality = 1)").count() <= 0.02 * joined.count()
    found = toxicity.toxicity_rows(docs, labels).withColumnRenamed("toxic", "p").join(labels, "doc_id")
    assert found.where("is_toxic <> (toxic = 1)").count() <= 0.03 * found.count()
    assert {r.doc_id: r.score for r in quality.quality_rows(odd).collect()}[1] == 0.0
    assert toxicity.toxicity_rows(odd, labels.limit(0)).where("toxic <> 0 or is_toxic").count() == 0
    assert quality.quality_rows(empty).count() == toxicity.toxicity_rows(empty, labels).count() == 0


def test_estimate_without_bad_votes():
    assert quality.estimate({}) == {}
    assert min(quality.estimate({"1111111": 50, "11111-1": 3}).values()) > 0.5


def test_mixing(odd, empty, spark):
    assert mixing.copies(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd).columns == [*odd.columns, "epoch", "mix_place"]
    real = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.copies(real, max_repetition=1.5).collect()
    assert len(rows) == 1000 and {r.copies for r in rows} <= {1, 2} and max(r.epochs for r in rows) <= 1.5 + 1e-6
    halved = mixing.copies(real, target_entropy=math.log(20) * 0.999, max_repetition=None, budget=100_000).collect()
    assert abs(sum(r.copies * r.n_tokens for r in halved) - 100_000) < 40_000


def test_decontamination(spark, empty):
    bench = spark.createDataFrame([(1, "A train leaves the old station with 12 apples and 12 km to go before the night falls over town"), (2, "tiny"), (3, None)], "item_id bigint, text string")
    text = "Noise here. A train leaves the old station with {} apples and {} km to go before the night falls over town, end."
    docs = spark.createDataFrame([(1, text.format(12, 12)), (2, text.format(7, 7)), (3, "A train leaves again"), (4, None), (None, text.format(5, 5)), (2, text.format(7, 7))], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised", (None, 1): "reparameterised"}
    torn = docs.selectExpr("doc_id", f"'{text.format(7, 8)}' AS text").limit(1)
    assert decontaminate.leaks(torn, bench).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4]
    assert decontaminate.leaks(empty, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_benchmark_passages_are_caught(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in " ".join(d.text.split())}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} >= want


def test_tool_calls(spark):
    call = lambda i, args, after=None: json.dumps({"tool_calls": [{"id": i, "name": "respond", "arguments": args, "after": after}]})
    rows = [(1, 0, "user", "hello you"), (1, 1, "assistant", "yes"), (1, 2, "user", ""), (2, 0, "assistant", call("a", '{"words":1,"prompt":"x"}')),
            (2, 1, "assistant", call("b", '{"prompt":2', "a")), (2, 2, "tool", '{"tool_call_id":"a","content":"done"}'), (2, 3, "tool", '{"tool_call_id":"zz","content":"?"}'),
            (3, 0, "assistant", call("p", "{}", "q")), (3, 1, "assistant", call("q", "{}", "p")), (None, None, None, None), (1, 0, "user", "hello you")]
    got = tool_calls.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    state = {(r.conv_id, r.call_id): (r.status, r.level, r.valid) for r in got}
    assert state[1, "turn-0"] == ("linked", 0, True) and state[1, "turn-2"][:2] == ("open", 1) and not state[1, "turn-2"][2]
    assert state[2, "a"] == ("linked", 0, True) and state[2, "b"] == ("open", 1, False) and state[2, "zz"][0] == "orphan"
    assert state[3, "p"][:2] == state[3, "q"][:2] == ("cycle", None) and state[None, "turn-none"][0] == "open"
    assert json.loads(next(r.json for r in got if r.call_id == "a"))["arguments"] == {"prompt": "x", "words": 1}
    assert tool_calls.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
    final = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in final.select("doc_id").collect()]
    assert set(ids) <= {r.doc_id for r in docs.collect()} and max(collections.Counter(ids).values()) <= 2
    assert np.isfinite(len(ids)) and len(ids) > 100
