"""Near-duplicate documents by SimHash fingerprints and BK-trees.

1. A text's word shingles (repeats included) are hashed by XXH64; a fingerprint bit is 1 where over half of the hashes have it.
   Documents with equal fingerprints form one class; from here on only distinct fingerprints travel.
2. Buckets. The 64 bits are cut into ``RADIUS + 1`` parts: two fingerprints within the radius agree on one part at least,
   so each goes to one bucket per part. A bucket with more than ``BUCKET`` fingerprints is cut again on the bits it leaves
   open, by the same argument, up to ``LEVELS`` times; by then 2**17 fingerprints are all that a bucket can hold.
3. Trees. Buckets are dealt to shards; a task turns each bucket of its shard into a BK-tree, level by level: the first
   fingerprint of a group is a node, the others go to the child keyed by their integer distance to it. The tree records
   links along its own short edges, and which subtrees they have made one component.
4. Search. Shard trees are joined with the ranges of fingerprints that ask them: broadcast up to ``BROADCAST_BYTES``, a
   shuffle beyond. numpy moves all queries of a range down together and follows only edges whose distance is within the
   radius of the query's own distance to the node. Subtrees that already lie in the query's component are not entered,
   so a large group of near copies costs no comparison of all its pairs, and no link between two components is lost.
5. Large-star and small-star join the links; a document's component is the smallest doc_id in it.

Defined cases: NULL, empty and white texts have the fingerprint zero, which is linked like any other. Fewer words than a
shingle are one shingle. Rows with NULL doc_id have a fingerprint, link nothing and have no component; ``deduplicated`` keeps
them. Rows that repeat a doc_id are one document: where their texts differ, it ties their fingerprints together. Other
columns are ignored, or kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import small_frame
from cohortwise.llm.common import partitions_for, written
from cohortwise.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one bucket before its open bits are cut again, and how often that may happen.
BUCKET, LEVELS = 2048, 6
#: Fingerprints of one shard of trees, and queries that go down its trees in one row.
SHARD_ROWS = RANGE = 16_384
#: Pairs of a query and a node that are compared at a time.
FRONTIER = 1_000_000
#: Bytes of all trees up to which they are broadcast.
BROADCAST_BYTES = 16_000_000
#: Classes with more rows than this, and than a ten-thousandth of all, are joined back by a broadcast of at most 10 000 rows.
HOT_ROWS = 10_000
#: Fixed table: the bits of a byte as eight counters of a byte each.
LANES = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


# --- fingerprints ------------------------------------------------------------

def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included (ASCII lower case, ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cut = map(joined.__getitem__, map(slice, starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), dtype=np.uint64, count=len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the strict majority of ``hashes``; zero without any."""
    if not len(hashes):
        return 0
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # at most 255 in a byte
    ones = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signer(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)
    return sign


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed integer."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_signer(size), "doc_id bigint, fp bigint")


# --- buckets -----------------------------------------------------------------

def parts_of(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` cut into runs of nearly equal length."""
    bits = [k for k in range(64) if mask >> k & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << k for k in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def buckets(classes: DataFrame, radius: int, most: int) -> DataFrame:
    """(open, fixed, fp): fingerprints by bucket; ``fixed`` are the bits of fp that ``open`` does not leave open."""
    spark, bucket = classes.sparkSession, ["open", "fixed"]
    wide = classes.select(F.lit(-1).cast("bigint").alias("open"), "fp")
    masks, done, count = [2**64 - 1], [], classes.count()
    for level in range(LEVELS):
        cuts = [(mask, mask & ~part) for mask in masks for part in parts_of(mask, radius + 1)]
        table = small_frame(spark, [(_signed(a), _signed(b)) for a, b in cuts], "open bigint, next bigint")
        dealt = wide.join(F.broadcast(table), "open").select(F.col("next").alias("open"), F.col("fp").bitwiseAND(F.bitwise_not("next")).alias("fixed"), "fp")
        sizes = dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = written(dealt.join(sizes, bucket), "buckets", count * (radius + 1))
        last = level == LEVELS - 1
        done.append((rows if last else rows.where(F.col("n") <= most)).select(*bucket, "fp"))
        wide, masks = rows.where(F.col("n") > most).select("open", "fp"), [b for _, b in cuts]
        if last or not (count := wide.count()):
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


# --- trees -------------------------------------------------------------------

class Forest:
    """BK-trees of several buckets. Nodes come level by level; ``edges`` are parent * 65 + distance, ascending."""

    def __init__(self, fps: np.ndarray, root: np.ndarray, edges: np.ndarray, levels: np.ndarray, radius: int):
        self.fps, self.root, self.edges, self.levels, self.radius = fps, root, edges, levels, radius
        self.roots = len(fps) - len(edges)
        self.label = np.arange(len(fps))
        for a, b in zip(levels[1:], levels[2:]):  # short edges are links
            parent, short = edges[a - self.roots:b - self.roots] // 65, edges[a - self.roots:b - self.roots] % 65 <= radius
            self.label[a:b] = np.where(short, self.label[parent], self.label[a:b])
        self.mix()

    @classmethod
    def grow(cls, bucket: np.ndarray, fps: np.ndarray, radius: int) -> "Forest":
        order = np.lexsort((fps, bucket))
        group, fps = bucket[order], fps[order]
        tree = np.unique(group, return_inverse=True)[1]
        nodes, roots, edges, levels = [], [], [], [0]
        group, first_level = tree, True
        while len(fps):
            first = np.r_[True, group[1:] != group[:-1]]
            number = levels[-1] + np.cumsum(first) - 1  # of the node that each item has reached
            nodes.append(fps[first])
            roots.append(tree[first])
            if not first_level:
                edges.append(group[first])
            levels.append(levels[-1] + int(first.sum()))
            pivot = fps[first][number - levels[-2]]
            keep = ~first
            key = number[keep] * 65 + np.bitwise_count(fps[keep] ^ pivot[keep])
            at = np.argsort(key, kind="stable")
            group, fps, tree, first_level = key[at], fps[keep][at], tree[keep][at], False
        joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        return cls(np.concatenate(nodes) if nodes else np.empty(0, dtype=np.uint64), joined(roots), joined(edges), np.array(levels), radius)

    def pack(self) -> dict[str, bytes]:
        return {"fps": self.fps.tobytes(), "roots": self.root.astype(np.int64).tobytes(), "edges": self.edges.astype(np.int64).tobytes(),
                "levels": self.levels.astype(np.int64).tobytes()}

    @classmethod
    def unpack(cls, fps: bytes, roots: bytes, edges: bytes, levels: bytes, radius: int) -> "Forest":
        return cls(np.frombuffer(fps, dtype=np.uint64), *(np.frombuffer(x, dtype=np.int64) for x in (roots, edges, levels)), radius)

    def short_edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.edges % 65 <= self.radius)
        return at + self.roots, self.edges[at] // 65

    def mix(self) -> None:
        """Mark nodes whose subtree holds more than one component."""
        self.mixed = np.zeros(len(self.fps), dtype=bool)
        for a, b in list(zip(self.levels[1:], self.levels[2:]))[::-1]:
            parent = self.edges[a - self.roots:b - self.roots] // 65
            np.logical_or.at(self.mixed, parent, self.mixed[a:b] | (self.label[a:b] != self.label[parent]))

    def links(self, first: int, last: int) -> list[tuple[int, int]]:
        """Pairs of nodes within the radius that join the components of nodes first..last-1 to others, as many as are needed."""
        found, largest = [], int(np.bincount(self.root).max(initial=1))
        step = max(16, FRONTIER // largest)
        for a in range(first, last, step):
            hits = self._down(np.arange(a, min(last, a + step)))
            if len(hits):
                found += self._union(hits)
        return found

    def _down(self, asking: np.ndarray) -> np.ndarray:
        query, node, hits = asking, self.root[asking], []
        while len(query):
            distance = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            near = (distance <= self.radius) & (self.label[query] != self.label[node])
            hits.append(np.stack([query[near], node[near]]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - self.radius, 0), "left")
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + self.radius, 64), "right")
            count = high - low
            query = np.repeat(query, count)
            node = self.roots + np.arange(len(query)) + np.repeat(low - (np.cumsum(count) - count), count)
            enter = self.mixed[node] | (self.label[node] != self.label[query])
            query, node = query[enter], node[enter]
        return np.concatenate(hits, axis=1) if hits else np.empty((2, 0), dtype=np.int64)

    def _union(self, hits: np.ndarray) -> list[tuple[int, int]]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        pairs, at = np.unique(np.sort(self.label[hits], axis=0), axis=1, return_index=True)
        used = []
        for (a, b), k in zip(pairs.T.tolist(), at.tolist()):
            if (a := top(a)) != (b := top(b)):
                above[max(a, b)] = min(a, b)
                used.append((int(hits[0, k]), int(hits[1, k])))
        if used:
            least = np.arange(len(self.fps))
            for x in list(above):
                least[x] = top(x)
            self.label = least[self.label]
            self.mix()
        return used


TREE = "shard int, nodes int, fps binary, roots binary, edges binary, levels binary"


def _grower(radius: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = rows.groupby(["open", "fixed"]).ngroup().to_numpy()
        forest = Forest.grow(bucket, rows["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame([{"shard": int(rows["shard"].iloc[0]), "nodes": len(forest.fps), **forest.pack()}])
    return grow


def _searcher(radius: int):
    """(fps, roots, edges, levels, first) to links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                *tree, first = (x.as_py() for x in row)
                forest = Forest.unpack(*tree, radius)
                child, parent = forest.short_edges()
                mine = (child >= first) & (child < first + RANGE)
                pairs = np.array(forest.links(first, min(len(forest.fps), first + RANGE)), dtype=np.int64).reshape(-1, 2)
                u, v = np.r_[child[mine], pairs[:, 0]], np.r_[parent[mine], pairs[:, 1]]
                signed = forest.fps.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[u]), pa.array(signed[v])], schema=schema)
    return search


def near_links(classes: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(u, v): fingerprints of ``classes`` (column fp, distinct) within the radius; enough of them to join every component."""
    rows = buckets(classes, radius, most)
    total = rows.count()
    rows = written(rows, "routed", total)
    shards = partitions_for(total, SHARD_ROWS)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("open", "fixed"), F.lit(shards)).cast("int"))
    trees = written(dealt.groupBy("shard").applyInPandas(_grower(radius), TREE).coalesce(shards), "trees")
    size = trees.agg(F.sum(sum(F.octet_length(c) for c in ("fps", "roots", "edges", "levels")))).first()[0] or 0
    ranges = trees.select("shard", F.explode(F.sequence(F.lit(0), F.col("nodes") - 1, F.lit(RANGE))).alias("first"))
    ranges = ranges.repartition(shards, "shard", "first")
    asked = ranges.join(F.broadcast(trees) if size <= BROADCAST_BYTES else trees.hint("shuffle_hash"), "shard")
    return asked.select("fps", "roots", "edges", "levels", "first").mapInArrow(_searcher(radius), "u bigint, v bigint")


# --- documents ---------------------------------------------------------------

def _joined_back(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Add ``component_id`` of the class to every row; classes with very many rows come by a broadcast, the rest by a shuffle."""
    hot = classes.where(F.col("n") > max(HOT_ROWS, total // HOT_ROWS)).select("fp", "component_id")
    # No more than HOT_ROWS classes can have more than a HOT_ROWS-th of all rows each.
    often = rows.join(F.broadcast(hot), "fp")
    rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti")
    return often.unionByName(rest.join(classes.select("fp", "component_id"), "fp", "left"))


def simhash_groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    signed = written(fingerprints(docs, size), "fingerprints")
    known, total = signed.where("doc_id IS NOT NULL"), signed.count()
    classes = written(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes", total)
    # A repeated doc_id with different texts is one document.
    ties = known.groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").select("doc_id", "v")
    tied = known.join(ties, "doc_id").where("fp <> v").select(F.col("fp").alias("u"), "v")
    links = written(near_links(classes.select("fp"), radius, most).unionAll(tied), "links")
    found = written(components(links).withColumnRenamed("node", "fp"), "components", total)
    least = found.join(classes, "fp").groupBy("component").agg(F.min("rep").alias("least"))
    linked = found.join(least, "component").select("fp", "least")
    resolved = written(classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")), "resolved", total)
    out = _joined_back(known, resolved, total).unionByName(signed.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest doc_id of each group, with all its columns."""
    gone = simhash_groups(docs, size, radius).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)
