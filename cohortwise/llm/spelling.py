"""Spelling variants: words that differ by one code point, found in a dictionary of pairs of trie nodes.

1. Tasks count the words of their documents; equal words meet in one aggregation. Words are numbered in code-point order.
2. Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. A node's number is mixed
   from its parent's number and its letter, so all tasks number alike without exchanging the tries, and a word of L
   letters has 2 L + 2 nodes whatever its length. Equal prefixes always get equal numbers.
3. The dictionary holds the integer pair (prefix node, suffix node) of each word with one position skipped, and of each
   word cut at one position. Words with the same pair at a skipped position differ by a replacement there; a cut pair
   that equals a skipped pair is an insertion. Of a run of equal letters only the first is skipped for insertions, so
   every pair of near words is found exactly once. A pair's group holds a word per letter of the alphabet at most.
4. The letters themselves are compared before a pair counts, for two nodes might share a number.
5. A word's form is its commonest near word, if it is at least twice as common; forms are followed by pointer doubling.

Defined cases: NULL and empty texts have no words. A NULL doc_id counts as the empty string. Repeated rows count as often
as they occur. Very long runs of letters are words like others; nothing grows with the square of their length. Other
columns are ignored. Without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import drop_written, written

#: Contract: shortest word in code points, fewest occurrences, and how much commoner a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Runs whose digest this divides lose a letter.
MODULUS = 97
#: Letters, in an encoding with one byte a code point; others become a question mark.
RUNS = re.compile(rb"[a-z\xC0-\xFF]+")
#: Distinct words, and bytes of words, that a counting task holds before it hands them on.
HELD_WORDS, HELD_BYTES = 300_000, 32_000_000
#: Dictionary rows in a batch.
BATCH_LETTERS = 200_000
MIX, FORWARD, BACKWARD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


# --- words -------------------------------------------------------------------

def words_of(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one document, after the deletion that the digest of document and word asks for."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(RUNS.findall((text or "").encode("latin-1", "replace").lower())).items():
        digest = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if digest % MODULUS == 0:
            k = digest % len(run)
            run = run[:k] + run[k + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, counts, held = pa.schema([("word", pa.string()), ("n", pa.int64())]), Counter(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(counts)
        for a in range(0, len(names), 50_000):
            part = names[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([counts[w] for w in part], pa.int64())], schema=schema)
        counts.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in words_of(doc_id, text.as_py()):
                if word not in counts:
                    held += len(word)
                counts[word] += n
            if len(counts) > HELD_WORDS or held > HELD_BYTES:
                yield from flush()
                held = 0
    yield from flush()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n) of all words with ``least`` occurrences; ids ascend in code-point order."""
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_count, "word string, n bigint")
    counts = seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return written(written(counts, "word-counts").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


# --- dictionary --------------------------------------------------------------

def _mixed(number: np.ndarray, letter: np.ndarray) -> np.ndarray:
    x = (number ^ letter) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def nodes_of(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all prefixes and suffixes of words laid end to end. A word at ``starts`` with L letters has L + 1 entries in
    either result, from its start plus its place: entry i belongs to the prefix before position i and the suffix from it on."""
    begin = starts + np.arange(len(starts))
    prefix, suffix = (np.zeros(len(letters) + len(starts), dtype=np.uint64) for _ in range(2))
    prefix[begin], suffix[begin + lengths] = FORWARD, BACKWARD
    order = np.argsort(-lengths, kind="stable")
    begin, starts, lengths = begin[order], starts[order], lengths[order]
    longer = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths.max(initial=0)), side="right")
    for depth, k in enumerate(longer.tolist()):  # one level of both tries for all words at a time
        at = begin[:k] + depth
        prefix[at + 1] = _mixed(prefix[at], letters[starts[:k] + depth])
        back = begin[:k] + lengths[:k] - depth
        suffix[back - 1] = _mixed(suffix[back], letters[starts[:k] + lengths[:k] - 1 - depth])
    return prefix, suffix


PAIRS = "p bigint, s bigint, at int, skip boolean, first boolean, id bigint, n bigint"
_PAIRS = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("at", pa.int32()), ("skip", pa.bool_()), ("first", pa.bool_()), ("id", pa.int64()), ("n", pa.int64())])


def _dictionary(ids: np.ndarray, words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    prefix, suffix = nodes_of(letters, starts, lengths)
    for extra in (0, 1):  # positions to skip, then places to cut
        size = lengths + extra
        owner = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        entry = starts[owner] + owner + at
        if extra:
            first = np.zeros(len(owner), dtype=bool)
        else:
            here = starts[owner] + at
            first = (at == 0) | (letters[here] != letters[np.maximum(here - 1, 0)])
        columns = [prefix[entry].view(np.int64), suffix[entry + 1 - extra].view(np.int64), at.astype(np.int32), np.full(len(owner), not extra), first, ids[owner], counts[owner]]
        for a in range(0, len(owner), BATCH_LETTERS):
            yield pa.RecordBatch.from_arrays([pa.array(c[a:a + BATCH_LETTERS]) for c in columns], schema=_PAIRS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = (batch.column(k).to_numpy() for k in (0, 2))
        held, first, size = [], 0, 0
        for k, word in enumerate(batch.column(1)):
            held.append(word.as_py())
            size += len(held[-1])
            if size >= BATCH_LETTERS or k + 1 == batch.num_rows:
                yield from _dictionary(ids[first:k + 1], held, counts[first:k + 1])
                held, first, size = [], k + 1, 0


def dictionary(words: DataFrame) -> DataFrame:
    """``PAIRS`` rows of every word: all skipped positions (``skip``) and all cuts."""
    return words.select("id", "word", "n").mapInArrow(_pairs, PAIRS)


def _met(a: Column, b: Column) -> Column:
    """Members of a pair's group that are near words: by replacement, or by the insertion of the letter skipped."""
    return F.when(a["skip"] & b["skip"], a["id"] != b["id"]).when(a["skip"], a["first"] & ~b["skip"]).otherwise(b["skip"] & b["first"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, n, other, other_n): every ordered pair of near words once."""
    groups = dictionary(words).groupBy("p", "s", "at").agg(F.collect_list(F.struct("skip", "first", "id", "n")).alias("met")).where(F.size("met") > 1)
    one = groups.select("at", "met", F.explode("met").alias("a"))
    pairs = one.select("at", "a", F.explode(F.filter("met", lambda b: _met(F.col("a"), b))).alias("b"))
    found = pairs.select(F.col("a.id").alias("id"), F.col("a.n").alias("n"), F.col("b.id").alias("other"), F.col("b.n").alias("other_n"), "at",
                         F.col("a.skip").cast("int").alias("a_skips"), F.col("b.skip").cast("int").alias("b_skips"))
    text = words.select("id", F.col("word").alias("a_word"))
    checked = found.join(text, "id").join(text.toDF("other", "b_word"), "other")
    same = (F.expr("substr(a_word, 1, at) = substr(b_word, 1, at)")
            & F.expr("substr(a_word, at + 1 + a_skips) = substr(b_word, at + 1 + b_skips)"))
    return checked.where(same).select("id", "n", "other", "other_n")


# --- forms -------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of every word with a form. Forms at least double in number, so pointer doubling ends after a few rounds."""
    now = written(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        up = now.toDF("mid", "top")
        after = written(now.join(up, now["root"] == up["mid"], "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        drop_written(now.sparkSession, [now.scratch])
        scratch, now = after.scratch, after.select("id", "root")
        now.scratch = scratch
        if not moved:
            return now


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, least)
    best = written(near_words(words).groupBy("id", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("back"), "other")).alias("best"))
                   .select("id", "n", "n_near", F.col("best.other").alias("form_id"), (-F.col("best.back")).alias("form_n")), "near")
    forms = best.where(F.col("form_n") >= times * F.col("n")).select("id", "form_id", "form_n")
    named = lambda key, name: words.select(F.col("id").alias(key), F.col("word").alias(name))
    resolved = (forms.join(_roots(forms).toDF("id", "root_id"), "id").join(named("form_id", "form"), "form_id").join(named("root_id", "root"), "root_id")
                .select("id", "form", "root", "form_n"))
    out = words.join(best.select("id", "n_near"), "id", "left").join(resolved, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
