"""SimHash groups against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortwise.llm import simhash
from cohortwise.llm.common import table
from cohortwise.shipping import ship

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, fp string, component_id string"


def plain_print(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k:k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(nodes, linked):
    """Smallest node reachable, by spreading until nothing changes."""
    least = {x: x for x in nodes}
    for start in sorted(nodes):
        if least[start] != start:
            continue
        stack = [start]
        while stack:
            x = stack.pop()
            for y in nodes:
                if least[y] > start and linked(x, y):
                    least[y] = start
                    stack.append(y)
    return least


def plain_groups(docs):
    prints = {}
    for d, t in docs:
        prints.setdefault(d, set()).add(plain_print(t))
    near = lambda a, b: any((x ^ y).bit_count() <= 4 for x in prints[a] for y in prints[b])
    return plain_components(set(prints), near)


LONG = " ".join(f"w{k}" for k in range(400))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG.upper()), (6, LONG.replace("w399", "x")), (7, "one two"), (9, "One\x0bTWO"), (8, "one two three four five"),
       (8, LONG + " more"), (10, "one two three four five"), (None, LONG), (11, "x " * 100_000), (11, "x " * 100_000)]


def test_odd_rows(spark):
    ship(spark)
    rows = simhash.simhash_groups(spark.createDataFrame([(d, t, "clash", "clash") for d, t in ODD], SCHEMA)).collect()
    want = plain_groups([r for r in ODD if r[0] is not None])
    assert sorted((r.doc_id, r.fingerprint) for r in rows if r.doc_id is not None) == sorted((d, f"{plain_print(t):016x}") for d, t in ODD if d is not None)
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert [(r.component_id, r.fingerprint) for r in rows if r.doc_id is None] == [(None, f"{plain_print(LONG):016x}")]
    # A repeated id with two texts ties their groups together.
    assert want[8] == want[10] == want[4]
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.deduplicated(spark.createDataFrame([(d, t, "clash", "clash") for d, t in ODD], SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {None, *(d for d, c in want.items() if d == c)}


def test_table_equals_brute_force(spark):
    ship(spark)
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = plain_groups(rows)
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()} == want


def test_hash_is_the_usual_one(spark):
    texts = ["one two three four", "", "Ça va"]
    rows = spark.createDataFrame([(t.lower(),) for t in texts if t], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    for r in rows:
        assert int(simhash.shingle_hashes(r.t).view(np.int64)[0]) == r.h


@pytest.mark.parametrize("most, large", [(2048, False), (3, False), (3, True)])
def test_links_join_all_neighbours(spark, most, large, monkeypatch):
    """Crowded fingerprints, also with buckets that are cut again and trees beyond the broadcast bound."""
    ship(spark)
    if large:
        monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (600, 5)).astype(np.uint64))
    fps = np.unique(np.bitwise_xor.reduce(np.c_[centres[rng.integers(0, 12, 600)], flips], axis=1))
    found = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"), most=most).collect()
    unsigned = lambda x: int(x) % 2**64
    links = {(unsigned(r.u), unsigned(r.v)) for r in found}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    pairs = links | {(b, a) for a, b in links}
    want = plain_components([int(x) for x in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    assert plain_components([int(x) for x in fps], lambda a, b: (a, b) in pairs) == want
    assert len(set(want.values())) > 12


def test_small_tables_are_few_files(spark, monkeypatch):
    """Tables of some rows are written by a few tasks, however many shuffle partitions a session has."""
    from cohortwise.llm import components
    ship(spark)
    files, plain = {}, simhash.written

    def counted(df, tag, *rows):
        out = plain(df, tag, *rows)
        files.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(components, "written", counted)
    many = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in many}
    try:
        for name, value in many.items():
            spark.conf.set(name, value)
        docs = spark.createDataFrame([(k, f"{LONG} {k % 7} {k % 3}", "", "") for k in range(400)], SCHEMA)
        got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(got) == 400
    assert all(max(files[tag]) <= 8 for tag in ("classes", "buckets", "routed", "trees", "components", "resolved"))
    assert max(files["edges"][1:]) <= 8
