"""Near-duplicate documents by MinHash, banding, verification on full sets, and connected components.

1. A document becomes the set of its distinct word shingles, as hashes of ``WIDTH`` bytes. Documents with equal sets form
   one numbered class, which stands for them from here on.
2. ``HASHES`` minima of a universal hash family give a signature, cut into bands of r rows. r is the largest
   for which a pair at the threshold shares no band with a probability of at most ``MISS``.
3. First links: in every band bucket the first class is compared with all others (a star, linear in
   the bucket). A pair must pass its signature estimate and then the exact test on full sets.
4. Large-star and small-star give components. Buckets that now lie in one component are done. In others, all members outside the
   bucket's commonest component are queries against all members, which come in blocks of ``BLOCK``; a block
   is one group, so a bucket of any size is split. Pairs that share an earlier band are left to that band.
   After this, every pair that shares a band is linked, in one component, or known not to be similar.
5. Components over all links.

Sets hold 64-bit hashes of shingles: the sizes and the test on full sets are exact but for two different shingles of the
compared documents sharing a hash, a chance of n * n / 2**64 for n shingles (below 1e-9 for 100 000 words).

Defined cases: NULL, empty and white texts have the empty set and are linked with nothing, not even each other.
Shorter texts than a shingle are one shingle. Rows with NULL doc_id take no part: their component is NULL and they
are kept. Rows that repeat a doc_id are one document if their texts agree; otherwise the texts are separate
classes under the same id and are linked. Other columns pass through ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import partitions_for, written
from cohortwise.llm.components import components

HASHES = 100
#: Largest chance that a pair at the threshold shares no band.
MISS = 1e-5
#: Members of a bucket that are compared in one group.
BLOCK = 256
#: Standard deviations by which a signature may underestimate.
SLACK = 5.0
#: Fixed seeds of the hash family.
_RNG = np.random.default_rng(20240607)
MULTIPLIERS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Words whose hashes a task remembers.
CACHE = 400_000
#: Rows of small groups that travel together.
PACK = 2048
BLOCK_KEYS = ["band", "bucket", "block", "part"]
#: Bytes of a stored shingle hash.
WIDTH = 8


def rows_per_band(threshold: float) -> int:
    fitting = [r for r in range(1, 21) if (1 - threshold**r) ** (HASHES // r) <= MISS]
    return max(fitting, default=1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (ASCII lower case, ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k:len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out & np.uint64(2 ** (8 * WIDTH) - 1))


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of the hash family over a non-empty set; the set is read in slices that stay in the processor's cache."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        part = found[at:at + 512]
        np.minimum(least, (part[None, :] * MULTIPLIERS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _packed(found: np.ndarray) -> bytes:
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(stored: bytes) -> np.ndarray:
    wide = np.zeros((len(stored) // WIDTH, 8), dtype=np.uint8)
    wide[:, :WIDTH] = np.frombuffer(stored, dtype=np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").ravel()


NARROW = "doc_id bigint, n bigint, set_key binary, bands array<bigint>"
FULL = "rep bigint, sig binary, items binary"


def _bands(sig: np.ndarray, rows: int) -> list[int]:
    return [xxhash.xxh64_intdigest(sig[k * rows:(k + 1) * rows].tobytes(), seed=k) - 2**63 for k in range(HASHES // rows)]


def _signer(size: int, rows: int):
    """(doc_id, text) to ``NARROW`` rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py(), size, hashes)
                key, bands = (xxhash.xxh128_digest(_packed(found)), _bands(signature(found), rows)) if len(found) else (None, None)
                out.append({"doc_id": doc_id, "n": len(found), "set_key": key, "bands": bands})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return sign


def _detailer(size: int):
    """(rep, set_key of its class, text) to ``FULL`` rows; other texts under the same id are passed over."""
    schema = pa.schema([("rep", pa.int64()), ("sig", pa.binary()), ("items", pa.binary())])

    def detail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            out = []
            for rep, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = shingles(text.as_py(), size, hashes)
                items = _packed(found)
                if len(found) and xxhash.xxh128_digest(items) == key:
                    out.append({"rep": rep, "sig": signature(found).tobytes(), "items": items})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return detail


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _promising(one: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """Signature verification: estimates not too far below the threshold."""
    t = percent / 100
    return (many == one).mean(axis=1) >= t - SLACK * np.sqrt(t * (1 - t) / HASHES)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, HASHES)


Side = dict[str, np.ndarray]


def _star_estimates(percent: int):
    """Members whose signature is close enough to that of their hub."""
    def check(hub: Side, others: Side) -> list[tuple]:
        near = _promising(_sigs(hub["sig"])[0], _sigs(others["sig"]), percent)
        return [(int(hub["hub"][0]), int(rep)) for rep in others["rep"][near]]
    return check


def _star(percent: int):
    def check(hub: Side, others: Side) -> list[tuple]:
        centre = _unpacked(hub["items"][0])
        return [(int(hub["hub"][0]), int(rep)) for rep, items in zip(others["rep"], others["items"]) if _similar(centre, _unpacked(items), percent)]
    return check


def _open_pairs(queries: Side, block: Side, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query its open block members: other component, no earlier band in common, promising signature."""
    rows, sigs, comps = rows_per_band(percent / 100), _sigs(block["sig"]), block["component"]
    earlier, t = int(block["band"][0]), percent / 100
    least = t - SLACK * np.sqrt(t * (1 - t) / HASHES)
    for k, (comp, sig) in enumerate(zip(queries["component"], _sigs(queries["sig"]))):
        equal = sigs == sig
        open_ = (comps != comp) & (equal.mean(axis=1) >= least)
        if open_.any():
            met = equal[:, :earlier * rows].reshape(len(sigs), earlier, rows).all(axis=2).any(axis=1)
            yield k, np.flatnonzero(open_ & ~met)


def _rest_estimates(percent: int):
    """Queries and members of a block that stand in a promising pair; one row each."""
    def check(queries: Side, block: Side) -> list[tuple]:
        asking, asked = [], set()
        for k, found in _open_pairs(queries, block, percent):
            if len(found):
                asking.append(k)
                asked.update(found.tolist())
        row = lambda side, k, asks: (*(int(side[c][k]) for c in (*BLOCK_KEYS, "component", "rep")), asks)
        return [row(queries, k, True) for k in asking] + [row(block, k, False) for k in sorted(asked)]
    return check


def _rest(percent: int):
    def check(queries: Side, block: Side) -> list[tuple]:
        links, items = [], [_unpacked(x) for x in block["items"]]
        for k, found in _open_pairs(queries, block, percent):
            mine = _unpacked(queries["items"][k])
            links += [(int(queries["rep"][k]), int(block["rep"][m])) for m in found if _similar(mine, items[m], percent)]
        return links
    return check


def _together(left: DataFrame, right: DataFrame, keys: list[str], check, schema: str, packs: int) -> DataFrame:
    """Apply ``check`` to the rows of both sides with equal keys. Small groups travel in packs: one group of the cogroup each."""
    names = [field.split()[0] for field in schema.split(", ")]
    pack = F.pmod(F.xxhash64(*keys), F.lit(packs))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            sides = [({c: part[c].to_numpy() for c in part.columns}, part.groupby(keys).indices) for part in (a, b)]
            (one, at), (two, other) = sides
            for key, rows in at.items():
                if key in other:
                    out += check({c: v[rows] for c, v in one.items()}, {c: v[other[key]] for c, v in two.items()})
        return pd.DataFrame(out, columns=names)

    dealt = [side.toDF(*side.columns).withColumn("pack", pack).groupBy("pack") for side in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(run, schema)


def _starred(pairs: DataFrame, details: DataFrame, check, schema: str) -> DataFrame:
    """``check`` of every hub with its members, the members of a large hub dealt to groups of about ``BLOCK``."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("of_hub"))
    salts = F.ceil(F.col("of_hub") / BLOCK).cast("int")
    columns = ["hub", "salt", *details.columns]
    others = pairs.join(sizes, "hub").withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int")).join(details, "rep").select(*columns)
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(details, F.col("hub") == F.col("rep")).select(*columns)
    return _together(centres, others, ["hub", "salt"], check, schema, partitions_for(pairs.count(), PACK))


def _links(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (u, v) between classes; ``reps`` has rep (number of the class), doc_id (its smallest), set_key and bands."""
    by_bucket = ["band", "bucket"]
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    hubs = buckets.groupBy(*by_bucket).agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    full = written(buckets.join(hubs, by_bucket), "buckets")
    # Signatures and sets of those that share a bucket with another; the rest of the texts is not read again.
    needed = written(reps.join(full.select("rep").distinct(), "rep").select("rep", F.col("doc_id").alias("of_id"), "set_key"), "needed")
    sets = written(docs.join(needed.hint("merge"), docs["doc_id"] == needed["of_id"]).select("rep", "set_key", "text").mapInArrow(_detailer(size), FULL), "sets")
    if sets.count() > needed.count():
        sets = written(sets.dropDuplicates(["rep"]), "sets")

    # Stars: estimates on signatures first, sets only for the promising pairs.
    met = written(full.where("rep <> hub").select("hub", "rep").distinct(), "stars")
    pairs = written(_starred(met, sets.select("rep", "sig"), _star_estimates(percent), "hub bigint, rep bigint"), "star-estimates")
    first = written(_starred(pairs, sets.select("rep", "items"), _star(percent), "u bigint, v bigint"), "star-links")

    # What the stars leave open: buckets whose members lie in more than one component.
    found = written(components(first), "components").withColumnRenamed("node", "rep")
    member = full.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = member.groupBy(*by_bucket, "component").agg(F.count(F.lit(1)).alias("n"))
    commonest = (counts.groupBy(*by_bucket).agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", (-F.col("component")).alias("back"))).alias("top"))
                 .where("kinds > 1").select(*by_bucket, (-F.col("top.back")).alias("main"), F.col("top.n").alias("in_main")))
    # Members are dealt to blocks, queries to parts: a group has about BLOCK of each at most.
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = written(member.join(commonest, by_bucket).withColumn("blocks", in_blocks(F.col("members")))
                    .withColumn("parts", in_blocks(F.col("members") - F.col("in_main"))), "open-buckets")
    chosen = lambda seed, of: F.pmod(F.xxhash64(F.col("rep"), F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    sigs, packs = sets.select("rep", "sig"), partitions_for(open_.count(), PACK)
    block = open_.select("rep", *by_bucket, "component", chosen(1, "blocks").alias("block"), every("parts").alias("part")).join(sigs, "rep")
    asking = open_.where("component <> main").select("rep", *by_bucket, "component", every("blocks").alias("block"), chosen(2, "parts").alias("part")).join(sigs, "rep")
    left = written(_together(asking, block, BLOCK_KEYS, _rest_estimates(percent),
                             "band int, bucket bigint, block int, part int, component bigint, rep bigint, asks boolean", packs), "rest-estimates")
    detailed = lambda asks: left.where("asks" if asks else "not asks").drop("asks").join(sets.select("rep", "sig", "items"), "rep")
    return first.unionAll(written(_together(detailed(True), detailed(False), BLOCK_KEYS, _rest(percent), "u bigint, v bigint", packs), "rest-links"))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_signer(size, rows_per_band(percent / 100)), NARROW), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = written(known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    member = written(known.select("doc_id", "set_key").join(classes.select("set_key", "rep", F.col("doc_id").alias("first_id")), "set_key")
                     .select("doc_id", "rep", "first_id").distinct(), "members")
    # A doc_id with several texts is in several classes: each is searched, the id ties them together.
    least = member.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v <> w").select("doc_id", "v")
    tied = member.join(least, "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v")
    links = written(_links(docs, classes, size, percent).unionAll(tied), "links")
    found = written(components(links).select(F.col("node").alias("rep"), "component"), "components")
    named = found.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("least"))
    resolved = (member.join(found.join(named, "component").select("rep", "least"), "rep", "left")
                .groupBy("doc_id").agg(F.min(F.coalesce("least", "first_id")).alias("least")))
    out = signed.select("doc_id", "n").join(resolved, "doc_id", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns."""
    gone = near_groups(docs, size, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)
