"""The pipeline's rows against a plain version of its last four stages, behind the classifier's own decisions; odd tables."""

import collections
import hashlib
import itertools
import math

import pandas as pd
import pytest
import regex

import corpus_pipeline
from cohortwise.llm import decontaminate, quality
from cohortwise.shipping import ship

SF = "/root/testdata/sf0.001"
SPACE = regex.compile(r"[\x20\x09-\x0D]+")


def exact(docs):
    best = {}
    for d, (text, _) in docs.items():
        key = SPACE.sub("", text or "")
        best[key] = min(best.get(key, (math.inf, 0)), (-len(text or ""), d))
    return {d: docs[d] for _, d in best.values()}


def near(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, root = {}, {d: d for d in docs}
    for d, (text, _) in docs.items():
        words = [w for w in SPACE.split((text or "").translate(lower)) if w]
        sets[d] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(docs, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            high, low = sorted((find(a), find(b)), reverse=True)
            root[high] = low
    return {d: docs[d] for d in docs if find(d) == d}


def tokens(text):
    text = regex.sub(r"(?<=[\p{L},;]\s{1,8})(\p{Lu}\p{L}+)", r"#n\1", text)
    text = regex.sub(r"(?<![\p{L}\d#])(\d+(?:[.,:]\d+)*)", r"#0\1", text)
    text = regex.sub(rf"(?<=\d)( ?)({decontaminate.UNITS})(?![\p{{L}}\d])", r" #u\2", text)
    return [w for w in regex.split(r"[^\p{L}\p{M}\d#]+", text.lower()) if w]


def leaks(doc, item):
    """Whether one form of the item has an occurrence that covers enough of it, or a long run, with consistent slots."""
    words, plain = doc, lambda ws: tuple(w[:2] if w.startswith("#") else w for w in ws)
    for form in {item, item.lower()}:
        own = tokens(form)
        size = min(len(own), decontaminate.WINDOW)
        if not size:
            continue
        places = collections.defaultdict(list)
        for at in range(len(words) - size + 1):
            places[plain(words[at:at + size])].append(at)
        windows = [own[p:p + size] for p in range(len(own) - size + 1)]
        by_value = [len(own) < decontaminate.LEAST or 2 * sum(not w.startswith("#") for w in ws) < size for ws in windows]
        hits = [(p, at) for p, ws in enumerate(windows) for at in places[plain(ws)] if not by_value[p] or ws == words[at:at + size]]
        width, parts = max(2, len(own) // 2), collections.defaultdict(list)
        for p, at in hits:
            shift = at - p
            for part in ("all", ("band", shift // width), ("half", math.floor(shift / width + 0.5))):
                parts[part].append((p, at))
        for shift, group in itertools.groupby(sorted(hits, key=lambda h: (h[1] - h[0], h[0])), key=lambda h: h[1] - h[0]):
            for _, run in itertools.groupby(enumerate(group), key=lambda e: e[1][0] - e[0]):
                run = [h for _, h in run]
                parts["run", shift, run[0]] = run
        for part, found in parts.items():
            seen = {p for p, _ in found}
            literal = by_value.count(False)
            coverage = max(len(seen) / len(windows), sum(not by_value[p] for p in seen) / literal if literal else 0)
            meanings = collections.defaultdict(set)
            for p, at in found:
                for mine, theirs in zip(own[p:p + size], words[at:at + size]):
                    if mine.startswith("#"):
                        meanings[mine].add(theirs)
            torn = sum(len(m) > 1 for m in meanings.values())
            long = part[0] == "run" and max(seen) - min(seen) + size >= decontaminate.RUN
            if (coverage >= decontaminate.COVERAGE or long) and torn * 3 <= len(meanings):
                return True
    return False


def mix(docs, limit=2.0, block_docs=8):
    """Copies of every document."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    size = {d: len([w for w in SPACE.split(t or "") if w]) for d, (t, _) in docs.items()}
    own = collections.defaultdict(list)
    for d, (_, source) in docs.items():
        own["n" if source is None else "v" + source].append(d)
    total = {s: sum(size[d] for d in ds) for s, ds in own.items()}
    p = {s: t / sum(total.values()) for s, t in total.items() if t}
    low, high = 0.0, 1.0
    spread = lambda a: max(v ** (a - 1) for v in p.values()) / min(v ** (a - 1) for v in p.values())
    while high - low > 1e-11:
        middle = (low + high) / 2
        low, high = (middle, high) if spread(middle) > limit else (low, middle)
    a = round(high, 9)
    largest = max(p[s] ** (1 - a) for s in p)
    copies = {}
    for s, ds in own.items():
        epochs = round(p[s] ** a * largest / p[s], 9) if s in p else 1.0
        blocks = collections.defaultdict(list)
        for d in ds:
            blocks[number(str(d)) % math.ceil(len(ds) / block_docs)].append(d)
        reached, rest = 0, round((epochs - math.floor(epochs)) * total[s])
        for b in sorted(blocks, key=lambda b: (number(f"{s}|{b}|{math.floor(epochs) + 1}"), b)):
            tokens_ = sum(size[d] for d in blocks[b])
            reached += tokens_
            copies |= {d: math.floor(epochs) + (reached - tokens_ / 2 <= rest) for d in blocks[b]}
    return copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given documents with copies, near copies, exact and changed benchmark items planted among them."""
    ship(spark)
    docs, bench = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    long = docs[docs.text.str.split().str.len().between(60, 400)].reset_index(drop=True)
    swap = lambda text: regex.sub(r"\d+", lambda m: str(int(m[0]) + 1), text)
    planted = [long.text[0] + "\n", long.text[1].replace(" ", "  ", 3), long.text[2] + " added words here", long.text[3].upper(),
               long.text[4] + " " + bench.text[0], long.text[5] + "\n" + swap(bench.text[1]) + "\n" + long.text[6], long.text[7] + " " + bench.text[2].lower()]
    more = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(planted)), "text": planted, "lang": "en", "source": "planted", "n_chars": [len(t) for t in planted]})
    path = tmp_path_factory.mktemp("corpus")
    pd.concat([docs, more], ignore_index=True).to_parquet(path / "documents.parquet")
    bench.to_parquet(path / "benchmark.parquet")
    return str(path)


def test_pipeline_equals_the_plain_version(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r.doc_id: (r.text, r.source) for r in quality.kept(table).collect()}
    assert len(good) > 100
    one = exact(good)
    single = near(one)
    items = [t for t in pd.read_parquet(f"{folder}/benchmark.parquet").text]
    clean = {d: v for d, v in single.items() if not any(leaks(words, i) for words in [tokens(v[0] or "")] for i in items)}
    want = mix(clean)
    assert len(good) > len(one) > len(single) > len(clean) and len(set(want.values())) > 1
    got = corpus_pipeline.run(spark, folder).select("doc_id", "epoch").collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted((d, e) for d, n in want.items() for e in range(1, n + 1))


def test_leaks_equal_the_plain_version(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for words in [tokens(d.text or "")] for i, text in items if leaks(words, text)}
    assert got == want and len(want) > 3


@pytest.mark.parametrize("rows", [0, 1, 7])
def test_every_stage_takes_odd_tables(spark, rows):
    """Empty tables, NULLs in any column, equal ids with different texts, extra columns with the operators' own names."""
    ship(spark)
    names = ["component", "key", "block", "copies", "content", "digest", "score", "source_tokens", "text_2"]
    text = "a plain and quiet sentence that nobody would ever throw away, with a few more words behind it. " * 3
    odd = [(1, text, "en", "a", 5), (None, text, None, None, None), (1, None, None, "a", 0), (2, "", "en", None, 0), (2, text + "x", "en", "b", 9), (3, "long " * 60_000, "de", "b", 1), (3, text, None, "b", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in odd[:rows]], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert [c for c in out.columns if c not in ("epoch", "mix_place")] == docs.columns, name
        found = out.collect()
        assert {r.doc_id for r in found} <= {r[0] for r in odd[:rows]} and (name == "source mixing" or len(found) <= rows), name
