"""Spelling variants and collocations against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortwise.llm import collocations, spelling
from cohortwise.llm.common import table
from cohortwise.shipping import ship

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, id bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "clash", 1, 2) for d, t, lang in rows], SCHEMA)


# --- spelling ----------------------------------------------------------------

def plain_words(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[start + 1:] == b[start + 1:]
    a, b = sorted((a, b), key=len)
    return a[start:] == b[start + 1:]


def plain_variants(docs):
    words = plain_words(docs)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    met = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if near(w, v)] for w in words}
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(met[w]), form[w] and words[form[w]])
    return out


def got_variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


ODD = [(1, None, None), (2, "", "en"), (3, "aaaab aaab aaaaab " * 3, "en"), (4, "élève Élève eleve elève " * 7 + "ELEVES " * 40, None), (4, "élève Élève eleve elève " * 7 + "ELEVES " * 40, None),
       (None, "colour color colours colors " * 3 + "color " * 9, "en"), (5, ("x" * 30_000 + " ") * 3 + ("x" * 29_999 + "y ") * 7 + "z" * 30_001 + " 1,2;", "de"),
       (6, "straße strasse straßé straßen " * 4, "de"), (7, "İstanbul İstanbul 漢字漢字漢字 " * 4, "tr")]


def test_variants_of_odd_rows(spark):
    ship(spark)
    got = got_variants(spelling.variants(frame(spark, ODD)))
    assert got == plain_variants(ODD)
    assert got["x" * 30_000][:2] == ("x" * 29_999 + "y",) * 2
    assert spelling.variants(frame(spark, [])).count() == 0 and spelling.variants(frame(spark, ODD[:2])).count() == 0


def test_variants_of_crowded_words(spark):
    """All words over few letters: every kind of neighbour, repeated letters, ties, long chains of forms."""
    ship(spark)
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("abé"), rng.integers(4, 8))) for _ in range(3000)]
    docs = [(k, " ".join(made[k * 10:k * 10 + 10] * int(rng.integers(1, 5))), "en") for k in range(300)]
    want = plain_variants(docs)
    assert got_variants(spelling.variants(frame(spark, docs))) == want
    assert max(v[3] for v in want.values()) > 10 and any(v[1] != w and v[1] != v[0] for w, v in want.items())


def test_variants_of_the_table(spark):
    ship(spark)
    docs = table(spark, SF, "documents")
    assert got_variants(spelling.variants(docs)) == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_shared_node_numbers_are_sorted_out(spark, monkeypatch):
    """With node numbers of a few values only, the letters still decide."""
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("abc"), 5)) for _ in range(120)})
    monkeypatch.setattr(spelling, "_mixed", lambda number, letter: (number + letter) % np.uint64(3))
    rows = [row for batch in spelling._dictionary(np.arange(len(words)), words, np.ones(len(words), dtype=np.int64)) for row in batch.to_pylist()]
    monkeypatch.setattr(spelling, "dictionary", lambda df: spark.createDataFrame([tuple(r.values()) for r in rows], spelling.PAIRS))
    found = spelling.near_words(spark.createDataFrame([(k, w, 1) for k, w in enumerate(words)], "id bigint, word string, n bigint")).collect()
    assert {(words[r.id], words[r.other]) for r in found} == {(a, b) for a in words for b in words if near(a, b)}


# --- collocations ------------------------------------------------------------

def plain_phrases(docs, least=10, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for size in (1, 2, 3):
                own.update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = {}
    for lang, f in counts.items():
        scored = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            longer = [t for t in f if len(t) == 3 and f[t] >= least and phrase in (t[:2], t[1:])] if len(phrase) == 2 else []
            if any(100 * f[t] >= 50 * a for t in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            scored.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, totals[lang], -score)
    return out


def got_phrases(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


PHRASES = [(1, None, "en"), (2, "", None), (3, "New York city. " * 12 + "new york, " * 30, "en"), (4, "a a a a a a a a a a a a a a;" * 2, None), (4, "a a a a a a a a a a a a a a;" * 2, None),
           (None, "new\tyork\ncity\x0bnew\x0cYORK! " * 9, "en"), (5, "één twee drie vier? " * 15 + "twee drie " * 30_000, "nl"), (6, "x\xa0y z : " * 11, "en"), (7, "...!!!  \t", "fr"),
           (8, "p q r. " * 10 + "p q. " * 10 + "q r. " * 11, "en")]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_of_odd_rows(spark, small, monkeypatch):
    ship(spark)
    if small:  # many chunks, tries, waves and parts
        for name, value in {"SHARD_PHRASES": 3, "WAVE_BYTES": 1, "RANKED": 2, "FAN_IN": 1, "CHUNK_TOKENS": 50}.items():
            monkeypatch.setattr(collocations, name, value)
    assert got_phrases(collocations.collocations(frame(spark, PHRASES))) == plain_phrases(PHRASES)
    assert collocations.collocations(frame(spark, [])).count() == 0 and collocations.collocations(frame(spark, PHRASES[:2])).count() == 0


def test_phrases_of_the_table(spark):
    ship(spark)
    docs = table(spark, SF, "documents")
    want = plain_phrases([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], least=4, top=150)
    assert got_phrases(collocations.collocations(docs, least=4, top=150)) == want and len(want) > 300


def test_double_array():
    rng = np.random.default_rng(8)
    two = np.unique(np.c_[rng.integers(0, 60, (900, 2)), np.full(900, -1)], axis=0)
    three = np.unique(np.c_[two[rng.integers(0, len(two), 700), :2], rng.integers(0, 60, 700)], axis=0)
    trie = collocations.DoubleArray.build(np.concatenate([two, three]))
    text = rng.integers(-1, 64, 20_000).astype(np.int32)
    wave = collocations.Wave(1, {0: (0, trie)})
    got = Counter()
    for at, numbers in wave.accepted(text, 3):
        got.update(tuple(w for w in trie.phrases[n].tolist() if w >= 0) for n in numbers.tolist())
    known = {tuple(w for w in row if w >= 0) for row in np.concatenate([two, three]).tolist()}
    want = Counter(tuple(text[k:k + size].tolist()) for size in (2, 3) for k in range(len(text) - size + 1))
    assert got == Counter({p: n for p, n in want.items() if p in known})


def test_score_is_exact(spark):
    a, left, right = 90_000_000_000_001, 90_000_000_000_007, 90_000_000_000_011
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint").select(collocations._score("l", "r").alias("s"))
    assert df.first().s == 1_000_000 * a * a // (left * right)
