"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped.

The model is three passes of map-side counting and merging by shard, none of which holds more than one shard:

1. Words. Tasks count hashed words of the training texts; shards are ranges of the hash. Each writes a sorted array of
   hashes with counts. Laid end to end they number the vocabulary.
2. Bigrams. Tasks map the vocabulary, turn words into numbers and count pairs of them, exact 64-bit keys. Shards are
   cut by a mixed key, so frequent words are spread. Each writes its sorted keys with counts, and returns the sums per
   context (tokens, and followers seen once, twice, more often) and per continuation, which are merged by number range.
3. Scores. Tasks map all arrays and look up their batch of tokens in sorted order.

Sums of tokens per context have 64 bits. Word numbers have 32 bits, and so have the counts of distinct followers and
continuations, which no vocabulary of 32-bit numbers can pass; a larger vocabulary is an error.

The arrays lie in the shared folder of the session, which must be a mounted file system; pages are shared by all
workers of a machine. Counts below ``SMALL`` take one byte, larger ones are kept aside.

A text is its words and one end token; a start token is the first context. Unknown words share one number.
Defined cases: NULL and empty texts consist of the end token. Rows with NULL doc_id count as training rows (their key is
the empty string). Repeated rows count and are scored as often as they occur. Without training rows N and V are 0,
base_score is log10(1/1) = 0 for each token and score is that of a uniform model of one word, 0. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import mounted_folder

#: Tokens of training text behind one shard, and tokens a task holds at a time.
SHARD_TOKENS = 4_000_000
CHUNK_TOKENS = 2_000_000
SCORE_TOKENS = 600_000
SMALL = 255
#: Partial sums that one task adds up.
FAN_IN = 64
#: Documents whose digest falls here are held out.
MODULUS, HELD = 7, 2
END = b"\n"
BLOBS = "shard int, keys binary, counts binary"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Packed columns of partial sums and their number types.
PACKED = {"context": "<u4", "total": "<u8", "once": "<u4", "twice": "<u4", "more": "<u4", "follow": "<u4", "times": "<u4"}
MOST_WORDS = 2**32 - 2


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS


def words_of(text: str | None) -> list[bytes]:
    """Words of a text and its end token (white space, so no word)."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class _Numbers(dict):
    """Word to its place among the words of a chunk."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, first row, words per row, hashes of the chunk's distinct words, place of every word)."""
    for b, batch in enumerate(batches):
        first, sizes, places, numbers, held = 0, [], [], _Numbers(), 0
        for row, text in enumerate(batch.column(column)):
            words = words_of(text.as_py())
            places.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
            sizes.append(len(words))
            held += len(words)
            if held >= most or row + 1 == batch.num_rows:
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
                yield b, first, np.array(sizes), hashes, np.concatenate(places)
                first, sizes, places, numbers, held = row + 1, [], [], _Numbers(), 0


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    if not keys:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, dtype=np.int64)
    return k[starts], np.add.reduceat(c, starts) if len(starts) else c


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """Cut sorted keys into one packed row per shard."""
    order = np.argsort(shard, kind="stable")
    keys, counts, cuts = keys[order], counts[order], np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [(s, keys[a:b].astype("<u8").tobytes(), counts[a:b].astype("<u4").tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pa.RecordBatch.from_pylist([dict(zip(("shard", "keys", "counts"), r)) for r in rows],
                                      schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _range_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return _range_shard(keys * MIX ^ (keys * MIX >> np.uint64(31)), shards)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under another name and rename: a second attempt of the task replaces the file as a whole."""
    part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, os.path.join(folder, f"{name}.npy"))


def _open(folder: str, name: str) -> np.ndarray:
    path = os.path.join(folder, f"{name}.npy")
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


def _find(stored: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of sorted wanted keys in a sorted array, -1 where absent."""
    if not len(stored):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
    return np.where(stored[at] == wanted, at, -1)


class Vocabulary:
    """Numbers of hashed words: offset of the shard plus place in it; the number after the last means unknown."""

    def __init__(self, folder: str, sizes: list[int]):
        self.shards, self.offsets = len(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.keys = [_open(folder, f"words-{s}") for s in range(self.shards)]
        self.counts = [_open(folder, f"word-counts-{s}") for s in range(self.shards)]
        self.size = int(self.offsets[-1])

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        ordered = hashes[order]
        number, count = np.full(len(hashes), self.size, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        cuts = np.searchsorted(_range_shard(ordered, self.shards), np.arange(self.shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            at = _find(self.keys[s], ordered[a:b])
            known = at >= 0
            number[order[a:b][known]] = at[known] + self.offsets[s]
            count[order[a:b][known]] = self.counts[s][at[known]]
        return number, count


class Model:
    """The mapped arrays and the discounts; scores chunks of tokens."""

    def __init__(self, folder: str, sizes: list[int], shards: int, parts: int, facts: dict):
        self.words, self.shards, self.facts = Vocabulary(folder, sizes), shards, facts
        self.keys = [_open(folder, f"pairs-{s}") for s in range(shards)]
        self.counts = [_open(folder, f"pair-counts-{s}") for s in range(shards)]
        self.large = [_open(folder, f"pair-large-{s}") for s in range(shards)]
        self.context = [_open(folder, f"context-{p}") for p in range(parts)]
        self.part_size = max(1, -(-(self.words.size + 1) // parts))

    def _per_number(self, numbers: np.ndarray) -> np.ndarray:
        """Rows (context tokens, followers seen once, twice, more; continuations) of distinct sorted numbers."""
        out = np.zeros((len(numbers), 5), dtype=np.int64)
        cuts = np.searchsorted(numbers, np.arange(len(self.context) + 1) * self.part_size)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[a:b] = self.context[p][numbers[a:b] - p * self.part_size]
        return out

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(keys), dtype=np.int64), _pair_shard(keys, self.shards)
        order = np.lexsort((keys, shard))
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            at = _find(self.keys[s], keys[order[a:b]])
            count = np.where(at >= 0, self.counts[s][np.maximum(at, 0)] if len(self.counts[s]) else 0, 0).astype(np.int64)
            big = np.flatnonzero(count == SMALL)
            if len(big):
                table = self.large[s]
                count[big] = table[np.searchsorted(table[:, 0], at[big]), 1]
            found[order[a:b]] = count
        return found

    def score(self, sizes: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and model score of each row of a chunk."""
        f, numbers = self.facts, None
        numbers, seen = self.words.numbers(hashes)
        token, c = numbers[places], seen[places].astype(float)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[starts] = self.words.size + 1  # the start token
        distinct, back = np.unique(token, return_inverse=True)
        continuations = self._per_number(np.minimum(distinct, self.words.size))[back, 4] * (token < self.words.size)
        contexts, back = np.unique(np.where(context == self.words.size + 1, self.words.size, context), return_inverse=True)
        stats = self._per_number(contexts)[back]
        stats[(context == self.words.size)] = 0  # an unknown word is no context; the start token's row lies there
        keys, back = np.unique((context.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64), return_inverse=True)
        pair = self._pair_counts(keys)[back]

        d1, d2 = np.array(f["unigram_discounts"]), np.array(f["bigram_discounts"])
        uniform = 1 / (f["distinct"] + 1)
        kinds = max(f["pairs"], 1)
        lower = np.maximum(continuations - d1[np.minimum(continuations, 3)], 0) / kinds + f["unigram_rest"] * uniform
        total = np.maximum(stats[:, 0], 1)
        rest = np.where(stats[:, 0] > 0, stats[:, 1:4] @ d2[1:] / total, 1.0)
        p = np.where(stats[:, 0] > 0, np.maximum(pair - d2[np.minimum(pair, 3)], 0) / total, 0.0) + rest * lower
        base = np.log10((c + 1) / (f["tokens"] + f["distinct"] + 1))
        add = lambda v: np.add.reduceat(v, starts)
        return sizes, add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """Discounts for counts of 0, 1, 2 and 3 or more; where the counts of counts do not tell, one half per count."""
    n, y = (ones, twos, threes, fours), ones / (ones + 2 * twos) if ones else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
        out.append(float(min(max(d, 0.05), k)))
    return out


def train(docs: DataFrame) -> dict:
    """Count and write the model of all rows of ``docs``; returns what ``Model`` needs (bounded by the shard count)."""
    spark = docs.sparkSession
    folder, rows = mounted_folder(spark, "bigrams"), docs.select("text")
    tokens = rows.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1)).first()[0] or 0
    shards = max(4, -(-tokens // SHARD_TOKENS))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, hashes, places in _chunks(batches, 0):
            keys, counts = _merge([hashes], [np.bincount(places, minlength=len(hashes))])
            yield _dealt(keys, counts, _range_shard(keys, shards), shards)

    def write_words(blobs: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge([np.frombuffer(x, "<u8") for x in blobs["keys"]], [np.frombuffer(x, "<u4") for x in blobs["counts"]])
        shard = int(blobs["shard"].iloc[0])
        _save(folder, f"words-{shard}", keys)
        _save(folder, f"word-counts-{shard}", counts)
        return pd.DataFrame({"shard": [shard], "size": [len(keys)], "total": [int(counts.sum())]})

    made = rows.mapInArrow(count_words, BLOBS).groupBy("shard").applyInPandas(write_words, "shard int, size bigint, total bigint").collect()
    sizes = [0] * shards
    for r in made:
        sizes[r.shard] = r["size"]
    for s in set(range(shards)) - {r.shard for r in made}:
        _save(folder, f"words-{s}", np.empty(0, dtype=np.uint64))
        _save(folder, f"word-counts-{s}", np.empty(0, dtype=np.int64))
    vocabulary = sum(sizes)
    if vocabulary > MOST_WORDS:
        raise ValueError(f"{vocabulary} distinct words are more than word numbers of 32 bits can tell apart")
    parts = max(1, -(-vocabulary // 1_000_000))
    part_size = max(1, -(-(vocabulary + 1) // parts))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(folder, sizes)
        for _, _, lengths, hashes, places in _chunks(batches, 0):
            token = words.numbers(hashes)[0][places]
            context = np.empty_like(token)
            context[1:] = token[:-1]
            context[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = words.size + 1
            keys, counts = np.unique((context.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64), return_counts=True)
            yield _dealt(keys, counts, _pair_shard(keys, shards), shards)

    def write_pairs(blobs: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge([np.frombuffer(x, "<u8") for x in blobs["keys"]], [np.frombuffer(x, "<u4") for x in blobs["counts"]])
        shard, big = int(blobs["shard"].iloc[0]), np.flatnonzero(counts >= SMALL)
        _save(folder, f"pairs-{shard}", keys)
        _save(folder, f"pair-counts-{shard}", np.minimum(counts, SMALL).astype(np.uint8))
        _save(folder, f"pair-large-{shard}", np.column_stack([big, counts[big]]))
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.minimum(first, vocabulary)  # the start token takes the row after the last word
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        sums = [np.add.reduceat(v, starts) for v in (counts, counts == 1, counts == 2, counts >= 3)]
        follow, times = np.unique(second, return_counts=True)
        of_counts = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        out = []
        for part in range(parts):
            low, high = part * part_size, (part + 1) * part_size
            a, b = np.searchsorted(first[starts], [low, high])
            c, d = np.searchsorted(follow, [low, high])
            packed = [first[starts][a:b], *(v[a:b] for v in sums), follow[c:d], times[c:d]]
            out.append((part, shard, *[v.astype(kind).tobytes() for v, kind in zip(packed, PACKED.values())], *(of_counts if part == 0 else [0] * 4), len(keys) if part == 0 else 0))
        return pd.DataFrame(out, columns=["part", "source", *PACKED, "n1", "n2", "n3", "n4", "pairs"])

    def merge_contexts(blobs: pd.DataFrame) -> pd.DataFrame:
        """Partial sums of some shards for one part, added up: one row, no longer than the part."""
        read = lambda c: np.concatenate([np.frombuffer(x, PACKED[c]) for x in blobs[c]]).astype(np.int64)
        low = int(blobs["part"].iloc[0]) * part_size
        out = []
        for key, values in (("context", ("total", "once", "twice", "more")), ("follow", ("times",))):
            at = read(key) - low
            dense = [np.bincount(at, weights=read(v), minlength=part_size).astype(np.int64) for v in values]  # exact up to 2**53
            found = np.flatnonzero(np.bincount(at, minlength=part_size))
            out += [found + low, *(d[found] for d in dense)]
        sums = [int(blobs[c].sum()) for c in ("n1", "n2", "n3", "n4", "pairs")]
        row = [int(blobs["part"].iloc[0]), int(blobs["source"].iloc[0]) // FAN_IN, *[v.astype(kind).tobytes() for v, kind in zip(out, PACKED.values())], *sums]
        return pd.DataFrame([row], columns=[c for c in blobs.columns if c != "batch"])

    def write_contexts(blobs: pd.DataFrame) -> pd.DataFrame:
        part = int(blobs["part"].iloc[0])
        table = np.zeros((part_size, 5), dtype=np.int64)
        read = lambda r, c: np.frombuffer(getattr(r, c), PACKED[c]).astype(np.int64)
        for r in blobs.itertuples(index=False):
            at = read(r, "context") - part * part_size
            table[at, :4] += np.column_stack([read(r, c) for c in ("total", "once", "twice", "more")])
            table[read(r, "follow") - part * part_size, 4] += read(r, "times")
        _save(folder, f"context-{part}", table)
        seen = [int((table[:, 4] == k).sum()) for k in (1, 2, 3, 4)]
        return pd.DataFrame([(part, *(int(blobs[c].sum()) for c in ("n1", "n2", "n3", "n4", "pairs")), *seen, int((table[:, 4] >= 3).sum()))],
                            columns=["part", "n1", "n2", "n3", "n4", "pairs", "k1", "k2", "k3", "k4", "k3p"])

    packed = ", ".join(f"{c} binary" for c in PACKED)
    numbers = "n1 bigint, n2 bigint, n3 bigint, n4 bigint, pairs bigint"
    partial = f"part int, source int, {packed}, {numbers}"
    sums, sources = rows.mapInArrow(count_pairs, BLOBS).groupBy("shard").applyInPandas(write_pairs, partial), shards
    while sources > FAN_IN:  # a tree, so that no task meets the sums of all shards
        sums = sums.groupBy("part", F.expr(f"source div {FAN_IN}").alias("batch")).applyInPandas(merge_contexts, partial)
        sources = -(-sources // FAN_IN)
    done = sums.groupBy("part").applyInPandas(write_contexts, f"part int, {numbers}, k1 bigint, k2 bigint, k3 bigint, k4 bigint, k3p bigint").collect()
    for p in set(range(parts)) - {r.part for r in done}:
        _save(folder, f"context-{p}", np.zeros((part_size, 5), dtype=np.int64))
    for s in range(shards):
        if not os.path.exists(os.path.join(folder, f"pairs-{s}.npy")):
            _save(folder, f"pairs-{s}", np.empty(0, dtype=np.uint64))
            _save(folder, f"pair-counts-{s}", np.empty(0, dtype=np.uint8))
            _save(folder, f"pair-large-{s}", np.empty((0, 2), dtype=np.int64))
    total = lambda c: sum(r[c] for r in done)
    pairs, low = total("pairs"), discounts(*(total(f"k{k}") for k in (1, 2, 3, 4)))
    rest = (low[1] * total("k1") + low[2] * total("k2") + low[3] * total("k3p")) / pairs if pairs else 1.0
    facts = {"tokens": sum(r.total for r in made), "distinct": vocabulary, "pairs": pairs, "unigram_rest": rest,
             "unigram_discounts": low, "bigram_discounts": discounts(*(total(f"n{k}") for k in (1, 2, 3, 4)))}
    return {"folder": folder, "sizes": sizes, "shards": shards, "parts": parts, "facts": facts}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Model(**model)
        for batch in batches:
            ids = batch.column(0)
            for _, first, sizes, hashes, places in _chunks(iter([batch]), 1, SCORE_TOKENS):
                n, known, base, own = mapped.score(sizes, hashes, places)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(sizes)), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(np.full(len(n), model["facts"]["tokens"]), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_rows(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and score all rows."""
    model = train(docs.where(remainder() != HELD))
    out = scored(docs, model)
    return out.select("doc_id", (remainder() == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
