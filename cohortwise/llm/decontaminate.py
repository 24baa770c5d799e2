"""Benchmark decontamination by template windows.

Texts are canonicalised: names (capitalised words inside a sentence), numbers and units after numbers become
typed placeholders, the rest lower-case words. Windows of ``WINDOW`` template tokens of every document are
hash-joined with those of the benchmark items. For every matching pair the values in the slots are aligned, once for the whole
document and once for each occurrence (windows of about the same offset): an item's value should always stand for the
same value in the document, and does for two thirds of the slots at least. Pairs with an occurrence that covers enough of an item and is consistent are leaks,
verbatim or re-parameterised, and so are pairs with a consistent run of ``RUN`` words, however long the item; the occurrence of most coverage, then of fewest changed values, describes the pair.

Tokens are hashed once; only windows that pass a bitmap of the benchmark's hashes leave their document, with the words they
hold. The benchmark's windows are broadcast up to ``BROADCAST_BYTES``; a larger benchmark is joined by a shuffle of window hashes. Windows made mostly of slots are matched by their real values. Items shorter than a window are matched
as a whole, below ``LEAST`` tokens by their real values. Scripts without spaces count every letter as a token.

Defined cases: NULL texts are empty and match nothing, items without tokens too. Different texts under one item_id, NULL
too, are different items and get a row each. Documents are told apart by doc_id and content, NULL ids too;
repeated rows are judged alike. Empty tables on either side give no pairs. Other columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import whole, written

WINDOW = 8
LEAST = 4
#: Share of an item's windows that must occur in the document.
COVERAGE = 0.3
#: Tokens of an unbroken run of matching windows that make a leak whatever the share.
RUN = 13
#: Bytes of the benchmark's windows up to which they are broadcast.
BROADCAST_BYTES = 64_000_000
GATE_BITS = 22
#: Units that may follow a number.
UNITS = ("mm|cm|m|km|in|inch|inches|ft|feet|foot|yd|yards?|miles?|mg|g|kg|tons?|lb|lbs|oz|ml|l|liters?|litres?|gallons?|s|sec|secs|seconds?|"
         "min|mins|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|kmh|mph|kph|w|kw|kwh|v|a|hz|mb|gb|tb")
NAME, NUMBER, UNIT = "#n", "#0", "#u"
#: All these scripts lie beyond U+0E00.
UNSPACED = "(?=[\\u0E00-\\x{10FFFF}])([[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]&&\\p{L}]\\p{M}*)"


def canonical(text: Column) -> Column:
    """Template tokens of a text: words, and ``#n``, ``#0``, ``#u`` followed by the value they stand for."""
    # A look at the next letter comes first: it is cheap and fails almost everywhere.
    named = F.regexp_replace(text, "(?=\\p{Lu})(?<=[\\p{L},;]\\s{1,8})(\\p{Lu}\\p{L}+)", NAME + "$1")
    numbered = F.regexp_replace(named, "(?=\\d)(?<![\\p{L}\\d#])(\\d+(?:[.,:]\\d+)*)", NUMBER + "$1")
    united = F.regexp_replace(numbered, f"(?<=\\d)( ?)({UNITS})(?![\\p{{L}}\\d])", f" {UNIT}$2")
    spaced = F.regexp_replace(united, UNSPACED, " $1 ")
    return F.filter(F.split(F.lower(spaced), "[^\\p{L}\\p{M}\\d#]+", -1), lambda w: w != "")


def template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit("#")), F.substring(w, 1, 2)).otherwise(w))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(kinds: list[tuple[int, bool]], wanted) -> Column:
    """(at, hash, doc_words) of the windows of the given sizes that ``wanted`` lets pass. ``exact`` and ``loose`` hold a hash per
    token, by its real value and by its template."""
    none = F.array().cast("array<struct<at:int,hash:bigint,doc_words:array<string>>>")

    def own(size: int, exact: bool) -> Column:
        tokens = "exact" if exact else "loose"
        every = F.transform(F.sequence(F.lit(0), F.size("words") - F.lit(size)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(tokens, i + 1, size)).alias("hash")))
        passed = F.filter(every, lambda w: wanted(w["hash"]))
        return F.when(F.size("words") >= size, F.transform(passed, lambda w: F.struct(w["at"].alias("at"), w["hash"].alias("hash"), F.slice("words", w["at"] + 1, size).alias("doc_words")))).otherwise(none)
    return F.concat(*[own(size, exact) for size, exact in kinds])


def _gate(index: DataFrame, rows: int):
    """A test that lets all hashes of ``index`` pass and few others: a bitmap, added up by groups, of at most 2**``GATE_BITS`` bits."""
    bits = min(GATE_BITS, max(10, (32 * rows).bit_length()))
    shift = lambda c, n: F.call_function("shiftrightunsigned", c, n)
    place = lambda h: shift(h, F.lit(70 - bits)).cast("int")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    parts = index.groupBy(place(F.col("hash")).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("hash")))).alias("bits"))
    table = [0] * 2 ** (bits - 6)
    for r in parts.collect():  # one row per 64 bits
        table[r["place"]] = r["bits"]
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into a constant
    return lambda h: shift(F.get(literal, place(h)), bit(h)).bitwiseAND(F.lit(1)) == 1


def item_windows(benchmark: DataFrame) -> DataFrame:
    """One row per window of an item: item_id, item (digest of its text), form (as it is or in lower case), size, item_tokens, pos, hash, exact (by real
    values), literal_windows and item_windows (their numbers in the item), item_words (values of the window)."""
    items = (benchmark.select("item_id", whole().alias("text")).dropDuplicates(["item_id", "text"])
             .select("item_id", F.xxhash64("text").alias("item"), F.posexplode(F.array_distinct(F.array("text", F.lower("text")))).alias("form", "text"))
             .select("item_id", "item", "form", canonical(F.col("text")).alias("words")).where(F.size("words") > 0)
             .withColumn("tokens", template(F.col("words"))).withColumn("size", F.least(F.size("words"), F.lit(WINDOW))))
    literal = lambda window: F.size(F.filter(window, lambda w: ~F.startswith(w, F.lit("#"))))
    window = lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, F.col("size")).alias("item_words"), F.xxhash64(F.slice("exact", i + 1, F.col("size"))).alias("of_words"), F.xxhash64(F.slice("loose", i + 1, F.col("size"))).alias("of_template"),
                                ((F.size("words") < LEAST) | (literal(F.slice("tokens", i + 1, F.col("size"))) * 2 < F.col("size"))).alias("exact"))
    items = written(items, "benchmark-tokens").withColumns({"exact": _hashed(F.col("words")), "loose": _hashed(F.col("tokens"))})
    items = items.withColumn("windows", F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), window))
    rows = items.select("item_id", "item", "form", "size", F.size("words").alias("item_tokens"), F.size("windows").alias("item_windows"),
                        F.size(F.filter("windows", lambda w: ~w["exact"])).alias("literal_windows"), F.explode("windows").alias("w"))
    return rows.select("item_id", "item", "form", "size", "item_tokens", "item_windows", "literal_windows", "w.pos", "w.exact", "w.item_words",
                       F.when(F.col("w.exact"), F.col("w.of_words")).otherwise(F.col("w.of_template")).alias("hash"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per window of a document that occurs in an item: doc_id, content, the item's columns, shift (offset), both sides' values."""
    index = written(item_windows(benchmark), "benchmark-windows")
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum(100 + F.octet_length(F.concat_ws(" ", "item_words"))).alias("b")).first()
    kinds = sorted((r["size"], r["exact"]) for r in index.select("size", "exact").distinct().collect()) or [(WINDOW, False)]
    rows = docs.select("doc_id", whole().alias("_text")).select("doc_id", F.xxhash64("_text").alias("content"), canonical(F.col("_text")).alias("words"))
    rows = rows.withColumns({"exact": _hashed(F.col("words")), "loose": _hashed(template(F.col("words")))})
    at = rows.select("doc_id", "content", F.explode(_windows(kinds, _gate(index, size["n"]))).alias("w")).select("doc_id", "content", "w.*")
    return at.join(F.broadcast(index) if (size["b"] or 0) <= BROADCAST_BYTES else index, "hash").select(
        "doc_id", "content", "item_id", "item", "form", "size", "item_tokens", "item_windows", "literal_windows", "pos", "exact",
        (F.col("at") - F.col("pos")).alias("shift"), "item_words", "doc_words")


def _occurrences() -> Column:
    """Parts of a match's document that are judged: all of it, the two overlapping bands of offsets the match lies in, and its run.

    Bands are half as wide as the item, so that two copies never share one and values may change their length.
    """
    width = F.greatest(F.lit(2), F.floor(F.col("item_tokens") / 2))
    part = lambda kind, at, run=F.lit(0): F.struct(F.lit(kind).alias("kind"), at.cast("bigint").alias("at"), run.cast("bigint").alias("run"))
    return F.array(part("all", F.lit(0)), part("band", F.floor(F.col("shift") / width)), part("half", F.floor(F.col("shift") / width + 0.5)),
                   part("run", F.col("shift"), F.col("run")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated (document, item) pairs: doc_id, content, item_id, coverage, slots, changed_slots, kind."""
    found = written(matches(docs, benchmark), "template-matches")
    pair = ["doc_id", "content", "item_id", "item"]
    form = [*pair, "form"]
    # Rows of a window share document, item and offset: at most the item's length.
    run = F.col("pos") - F.dense_rank().over(Window.partitionBy(*form, "shift").orderBy("pos"))
    parts = found.dropDuplicates([*form, "shift", "pos"]).withColumn("run", run).select("*", F.explode(_occurrences()).alias("occurrence"))
    key = [*form, "occurrence"]
    share = lambda pos, total: F.coalesce(F.try_divide(F.size(F.collect_set(pos)), F.first(total)), F.lit(0.0))
    covered = parts.groupBy(*key).agg(F.greatest(share(F.when(~F.col("exact"), F.col("pos")), "literal_windows"), share(F.col("pos"), "item_windows")).alias("coverage"),
                                      (F.max("pos") - F.min("pos") + F.first("size")).alias("span"))
    aligned = parts.select(*key, F.explode(F.arrays_zip("item_words", "doc_words")).alias("slot")).where(F.startswith("slot.item_words", F.lit("#")))
    per_value = aligned.groupBy(*key, F.col("slot.item_words").alias("value")).agg(
        F.countDistinct("slot.doc_words").alias("meanings"), F.max((F.col("slot.doc_words") != F.col("slot.item_words")).cast("int")).alias("changed"))
    slots = per_value.groupBy(*key).agg(F.count(F.lit(1)).alias("slots"), F.sum("changed").alias("changed_slots"),
                                        F.sum((F.col("meanings") > 1).cast("int")).alias("torn"))
    same = lambda: [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    joined = covered.alias("c").join(slots.alias("s"), same(), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    best = (joined.where(((F.col("coverage") >= COVERAGE) | ((F.col("c.occurrence.kind") == "run") & (F.col("span") >= RUN))) & (number("torn") * 3 <= number("slots")))
            .groupBy(*[F.col(f"c.{k}").alias(k) for k in pair])
            .agg(F.max(F.struct("coverage", (-number("changed_slots")).alias("same"), number("slots").alias("slots"))).alias("best")))
    return best.select("doc_id", "content", "item_id", F.round("best.coverage", 6).alias("coverage"), F.col("best.slots").alias("slots"),
                       (-F.col("best.same")).alias("changed_slots"),
                       F.when(F.col("best.same") < 0, "reparameterised").otherwise("verbatim").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no benchmark item, with all their columns."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("content").alias("__leak")).distinct()
    marked = docs.withColumn("__content", F.xxhash64(whole()))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["__id"]) & (F.col("__content") == F.col("__leak")), "left_anti").select(*docs.columns)
