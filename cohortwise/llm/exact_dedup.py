"""Exact deduplication by a minimal perfect hash over the digests of earlier documents.

Documents are equal when their texts agree after white space is deleted. The distinct digests of the
history are cut into shards of about ``SHARD_KEYS`` keys. Each shard gets a minimal perfect hash (hash and
displace) whose slots hold the full 32-byte digest and the locator of the group's winner. An incoming
digest is looked up in its shard and counts as a repeat only if all bytes of the slot agree; digests that
are not members form groups among themselves. Both sides are aggregated by digest before they meet, so a
group of copies of any size is one row there.

Defined cases: NULL text is the empty text, and all empty texts form one group. Rows with NULL doc_id lose
against rows with one; if a group has only such rows, keep_id is NULL and they are kept. Rows that repeat
a doc_id with the same text are one document: each gets the same values, and ``deduplicated`` returns one
of them. Empty tables give empty results. Further columns pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import partitions_for, whole, without, written

#: Keys in a shard of the hash on average; a shard is built and read in one task.
SHARD_KEYS = 8192
KEYS_PER_BUCKET = 3


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and slot of each key for distinct 32-byte digests given as an (n, 4) uint64 array.

    A displacement >= 0 is the seed of a bucket; -1 - slot sends the only key of a bucket straight to it.
    """
    n = len(digests)
    seeds = np.zeros(max(1, -(-n // KEYS_PER_BUCKET)), dtype=np.int64)
    slots = np.zeros(n, dtype=np.int64)
    bucket = (digests[:, 1] % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(seeds))
    ends = np.cumsum(sizes)
    free = np.ones(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        members = order[ends[b] - sizes[b]:ends[b]]
        seed = 0
        while True:
            at = slot_of(digests[members], np.int64(seed), n)
            if free[at].all() and len(np.unique(at)) == len(at):
                break
            seed += 1
        seeds[b], slots[members], free[at] = seed, at, False
    for b, at in zip(np.flatnonzero(sizes == 1), np.flatnonzero(free)):
        seeds[b], slots[order[ends[b] - 1]] = -1 - at, at
    return seeds, slots


def slot_of(digests: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    mixed = (digests[:, 2] ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * (digests[:, 3] | np.uint64(1))
    return ((mixed >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def look_up(digests: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[(digests[:, 1] % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -1 - seed, slot_of(digests, np.maximum(seed, 0), n))


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), dtype="<u8").reshape(-1, 4)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    seeds, slots = build_hash(_words(rows["digest"]))
    by_slot = rows.iloc[np.argsort(slots)]
    return pd.DataFrame({
        "shard": [int(rows["shard"].iloc[0])], "seeds": [seeds.astype("<i8").tobytes()],
        "slots": [b"".join(map(bytes, by_slot["digest"]))], "locators": [by_slot["locator"].tolist()],
        "lengths": [by_slot["length"].tolist()], "counts": [by_slot["n"].tolist()],
    })


SHARD_SCHEMA = "shard int, seeds binary, slots binary, locators array<bigint>, lengths array<bigint>, counts array<bigint>"
FOUND_SCHEMA = "digest binary, locator bigint, length bigint, n bigint"
#: Locator of a row without doc_id: behind every real one.
NO_ID = 2**63 - 1


def _resolve_shard(shard: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: members merged with the slot's winner, nonmembers, and slots without a repeat."""
    names = ["digest", "locator", "length", "n"]
    incoming = [(bytes(d), int(i), int(l), int(c)) for d, i, l, c in rows[names].itertuples(index=False)] if len(rows) else []
    if not len(shard):
        return pd.DataFrame(incoming, columns=names)
    table = shard.iloc[0]
    slots, seeds = bytes(table["slots"]), np.frombuffer(table["seeds"], dtype="<i8")
    n = len(slots) // 32
    groups = [[slots[32 * k:32 * k + 32], *(int(table[c][k]) for c in ("locators", "lengths", "counts"))] for k in range(n)]
    alone = []
    at = look_up(_words([r[0] for r in incoming]), seeds, n) if incoming else []
    for row, k in zip(incoming, at):
        group = groups[k]
        if group[0] != row[0]:
            alone.append(list(row))
            continue
        group[3] += row[3]
        if (row[2], -row[1]) > (group[2], -group[1]):
            group[1], group[2] = row[1], row[2]
    return pd.DataFrame(groups + alone, columns=names)


def _winners(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original text, then the smallest doc_id, stays."""
    best = F.max(F.struct("length", (-F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))).alias("best")
    return (rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
            .select("digest", (-F.col("best.least")).alias("locator"), F.col("best.length").alias("length"), "n"))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, 32-byte digest of the text without white space, code points of the text, history or not."""
    text = whole()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(without(text), 256)).alias("digest"),
        F.length(text).cast("bigint").alias("length"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0).alias("is_history"),
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The hash of a history: one row per shard. ``history`` has one row per digest, as ``_winners`` gives it."""
    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build_shard, SHARD_SCHEMA)


def _shard(shards: int):
    # Digest bytes are uniform; the first eight hex digits choose the shard.
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint") % shards).cast("int")


def groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, n) of every group of ``rows`` (as ``digest_rows`` gives them)."""
    shards = partitions_for(rows.count(), SHARD_KEYS)
    index = written(build_index(_winners(rows.where("is_history")), shards), "digest-hash")
    incoming = _winners(rows.where("not is_history")).withColumn("shard", _shard(shards))
    found = index.groupBy("shard").cogroup(incoming.groupBy("shard")).applyInPandas(_resolve_shard, FOUND_SCHEMA)
    return found.select("digest", F.when(F.col("locator") != NO_ID, F.col("locator")).alias("keep_id"), "n")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digest_rows(docs), "digests")
    return rows.join(groups(rows), "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; one row for each group."""
    rows = written(digest_rows(docs), "digests")
    found = groups(rows).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"))
    # Rows per surviving (digest, doc_id); above one where whole rows repeat.
    stays = written(
        rows.join(found, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep")))
        .groupBy("__digest", "__keep").agg(F.count(F.lit(1)).alias("__rows")), "stays")
    kept = docs.withColumn("__own", F.unhex(F.sha2(without(whole()), 256))).join(
        stays, (F.col("__own") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep")))
    out = kept.where("__rows = 1")
    if not stays.where("__rows > 1").isEmpty():
        out = out.unionByName(kept.where("__rows > 1").dropDuplicates(["__own"]))
    return out.select(*docs.columns)
