"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of vote
patterns of all documents (at most 3^labellers rows) estimates each labeller's rates under either class, and with
them a posterior per pattern. Posteriors are the soft labels of a linear scorer over hashed token shapes, trained on
a bounded sample of ``TRAIN_ROWS`` documents. The scorer decides.

Defined cases: NULL, empty and white texts have no votes; their score is 0 and they are rejected. Repeated rows and
NULL ids are rows of their own. Without documents, or with texts of one kind only, EM falls back on its starting
point (a bad vote makes a document bad). Other columns pass through ``kept``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import written

#: Documents that train the scorer; a parameter, the sample is taken by digest.
TRAIN_ROWS = 4000
DIMENSIONS = 1024
GOOD, BAD, ABSTAIN = "1", "0", "-"
THRESHOLD = 0.5
#: Largest rate of bad votes of a labeller among good documents.
FALSE_ALARMS = 0.0005

_SYMBOLS = re.compile(rb"([^\w\s!.,\x80-\xff])\1\1")
_UPPER, _LOWER = re.compile(rb"[A-Z]"), re.compile(rb"[a-z]")


def _vote(value: float, bad_above: float, good_below: float) -> str:
    return BAD if value > bad_above else GOOD if value < good_below else ABSTAIN


def votes(text: bytes, words: list[bytes]) -> str:
    """One character per labeller: symbol runs, capitals, exclamations, repeats, tables, variety, word length."""
    n = len(words)
    if not n:
        return ABSTAIN * 7
    upper, lower = len(_UPPER.findall(text)), len(_LOWER.findall(text))
    repeats = sum(map(operator.eq, words, words[1:])) / n
    variety = len(set(words)) / n
    return "".join((
        _vote(len(_SYMBOLS.findall(text)) / n, 0.2, 0.05),
        _vote(upper / (upper + lower) if upper + lower > 3 else 0.25, 0.5, 0.3),
        _vote(text.count(b"!!") / n, 0.2, 0.05),
        _vote(repeats, 0.3, 0.1),
        _vote(words.count(b"|") / n, 0.2, 0.05),
        _vote(1 - variety, 0.85, 0.6) if n >= 20 else ABSTAIN,
        _vote(len(text) / n, 25, 15),
    ))


def estimate(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior of good for each vote pattern, by EM over the labellers' rates of bad votes in either class.

    Abstentions say nothing. In the good class a rate is held at ``FALSE_ALARMS`` at most: labellers may overlook
    bad documents, but they rarely accuse good ones. Without that prior EM may settle on other clusters.
    """
    if not patterns:
        return {}
    keys, counts = list(patterns), np.array(list(patterns.values()), dtype=float)
    bad = np.array([[v == BAD for v in key] for key in keys], dtype=float)
    cast = np.array([[v != ABSTAIN for v in key] for key in keys], dtype=float)
    good = np.array([0.02 if BAD in key else 0.98 for key in keys])
    for _ in range(rounds):
        weight = np.stack([good, 1 - good]) * counts
        share = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        rates = (weight @ bad + 0.01) / (weight @ cast + 0.1)
        rates[0] = np.minimum(rates[0], FALSE_ALARMS)
        log = np.log(share)[:, None] + np.log(rates) @ bad.T + np.log(1 - rates) @ (cast - bad).T
        good = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return dict(zip(keys, good.tolist()))


class _Shapes(dict):
    """Word to the hashed number of its shape: runs of letters, capitals and digits shrink to one character."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = re.sub(rb"[a-z\x80-\xff]+", b"a", word)
        shape = re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]+", b"0", shape))[:24]
        h = 2166136261
        for byte in shape:
            h = (h ^ byte) * 16777619 & 0xFFFFFFFF
        self[word] = value = (h ^ h >> 15) % (DIMENSIONS - 3)
        return value


def features(words: list[bytes], shapes: dict) -> np.ndarray:
    """Square roots of the shares of token shapes, then repeats, variety and a constant."""
    n = len(words)
    out = np.bincount(np.fromiter(map(shapes.__getitem__, words), dtype=np.int64, count=n), minlength=DIMENSIONS).astype(float) / n
    out[-3:] = sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, 1.0
    return np.sqrt(out)


def train(matrix: np.ndarray, soft: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Nesterov steps; both classes weigh the same."""
    weights = soft / max(soft.sum(), 1e-9) + (1 - soft) / max((1 - soft).sum(), 1e-9)
    weights /= weights.sum()
    w = momentum = np.zeros(matrix.shape[1])
    for k in range(rounds):
        ahead = momentum
        error = (1 / (1 + np.exp(-np.clip(matrix @ ahead, -40, 40))) - soft) * weights
        after = ahead - 2.0 * (matrix.T @ error + ridge * ahead)
        momentum, w = after + (k / (k + 3)) * (after - w), after
    return w


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes(t, t.split()) for t in map(_bytes, batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["votes"])


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = _Shapes()
    for batch in batches:
        for text in map(_bytes, batch.column(0)):
            words = text.split()
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([votes(text, words)]), pa.array([features(words, shapes).astype("<f4").tobytes()])], names=["votes", "x"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Posteriors by vote pattern (all documents) and the scorer's weights (bounded sample)."""
    counted = written(docs.select("text").mapInArrow(_voter, "votes string").groupBy("votes").count(), "votes")
    patterns = {r.votes: r["count"] for r in counted.collect()}  # at most 3^7 rows
    posterior, total = estimate(patterns), sum(patterns.values())
    # A digest of the text takes an even sample; the margin makes up for the spread of its size.
    share = min(1.0, train_rows / max(total, 1))
    digest = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)
    rows = docs.where(digest).select("text").mapInArrow(_featurer, "votes string, x binary").limit(2 * train_rows).collect()
    if not rows:
        return posterior, np.zeros(DIMENSIONS)
    matrix = np.stack([np.frombuffer(r.x, dtype="<f4") for r in rows]).astype(float)
    return posterior, train(matrix, np.array([posterior[r.votes] for r in rows]))


def scored(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of the documents plus ``__bad_votes``, ``__posterior`` and ``__score`` (probability of good)."""
    posterior, weights = fit(docs, train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in batches:
            out = []
            for text in map(_bytes, batch.column(batch.schema.get_field_index("text"))):
                words = text.split()
                pattern = votes(text, words)
                p = float(1 / (1 + np.exp(-np.clip(features(words, shapes) @ weights, -40, 40)))) if words else 0.0
                out.append((pattern.count(BAD), round(posterior.get(pattern, 0.0), 9) if words else 0.0, round(p, 9)))
            columns = list(zip(*out)) or [[], [], []]
            added = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "__bad_votes", "__posterior", "__score"])

    schema = docs.schema
    for name, kind in (("__bad_votes", "long"), ("__posterior", "double"), ("__score", "double")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return docs.mapInArrow(score, schema)


def quality_rows(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, bad_votes, posterior, score, kept."""
    return scored(docs.select("doc_id", "text"), train_rows).select(
        "doc_id", F.col("__bad_votes").alias("bad_votes"), F.col("__posterior").alias("posterior"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).alias("kept"))


def kept(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return scored(docs, train_rows).where(F.col("__score") >= THRESHOLD).select(*docs.columns)
