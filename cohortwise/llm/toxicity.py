"""Toxicity by a classifier chain.

Categories are predicted one after the other: insults to persons, demeaning words, then toxicity as a whole. Each
model is linear over hashed words and word beginnings (binary, scaled by their log-odds), and sees the
probabilities of the categories before it. In training those are out-of-fold predictions, so later models meet
earlier ones as they are on unseen documents. The first two targets are the labelled toxic documents that
contain a word of a short list; the last is the label itself.

Training uses at most ``TRAIN_ROWS`` labelled documents, taken by digest; everything else covers all documents.

Defined cases: NULL and empty texts have no features and probability 0. Labels that are NULL or contradict each
other for a doc_id are not used. Without labels of both kinds all probabilities are 0. Repeated rows and NULL
ids get rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents used for training; a parameter.
TRAIN_ROWS = 6000
FOLDS = 3
DIMENSIONS = 2**16
#: Words that mark the two narrower categories in labelled toxic documents.
INSULTS = ("idiot", "moron", "loser", "clown", "scum", "trash")
DEMEANING = ("pathetic", "worthless", "disgusting", "stupid")
CHAIN = ("insult", "demeaning", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


class _Hashed(dict):
    """Word to the hashed numbers of itself and its beginnings of three, four and five letters."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        forms = {word, *(f"{word[:k]}*" for k in (3, 4, 5) if len(word) >= k)}
        self[word] = found = tuple(xxhash.xxh32_intdigest(f.encode()) % DIMENSIONS for f in forms)
        return found


def features(text: str | None, hashed: dict) -> np.ndarray:
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((k for w in words for k in hashed[w]), dtype=np.int64))


class Rows:
    """Sparse binary rows: the feature and the row of each entry, and the number of rows."""

    def __init__(self, at: np.ndarray, owner: np.ndarray, n: int):
        self.at, self.owner, self.n = at, owner, n

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))

    def only(self, features: np.ndarray) -> Rows:
        kept = features[self.at]
        return Rows(self.at[kept], self.owner[kept], self.n)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.at], minlength=self.n)

    def back(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=error[self.owner], minlength=DIMENSIONS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: Rows, earlier: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hashed features (log-odds folded in) and of (earlier probabilities, constant)."""
    pos, neg = (train & (y > 0)).astype(float), (train & (y == 0)).astype(float)
    odds = np.log((x.back(pos) + 0.5) / (pos.sum() + 1)) - np.log((x.back(neg) + 0.5) / (neg.sum() + 1))
    # Features of even odds or seen once or twice do not take part; few entries are left.
    active = (x.back(pos + neg) > 2) & (np.abs(odds) > 1)
    scale, x = np.where(active, odds, 0.0), x.only(active)
    dense = np.column_stack([earlier, np.ones(len(y))])
    weight = (pos / max(pos.sum(), 1) + neg / max(neg.sum(), 1)) / 2
    # Log-odds of frequent words are small: squared scale, summed over a row, bounds the step.
    step = 4.0 / max(float((x.times(scale**2) + (dense**2).sum(axis=1)).max(initial=1.0)), 1.0)
    w, d = np.zeros(DIMENSIONS), np.zeros(dense.shape[1])
    look_w, look_d = w, d
    for k in range(rounds):
        error = (_sigmoid(x.times(scale * look_w) + dense @ look_d) - (y > 0)) * weight
        new_w, new_d = look_w - step * (scale * x.back(error) + 1e-5 * look_w), look_d - step * (dense.T @ error)
        factor = k / (k + 3)
        look_w, look_d, w, d = new_w + factor * (new_w - w), new_d + factor * (new_d - d), new_w, new_d
    return scale * w, d


def fit_chain(rows: list[np.ndarray], targets: np.ndarray) -> dict:
    """Models of the chain and the threshold of the last one (best F1 on out-of-fold predictions)."""
    x, n = Rows.of(rows), len(rows)
    fold, everyone = np.arange(n) % FOLDS, np.ones(n, dtype=bool)
    earlier, models, out = np.empty((n, 0)), [], np.zeros(n)
    for k in range(len(CHAIN)):
        out = np.zeros(n)
        for f in range(FOLDS):
            w, d = fit_linear(x, earlier, targets[:, k], fold != f)
            out = np.where(fold == f, _sigmoid(x.times(w) + np.column_stack([earlier, np.ones(n)]) @ d), out)
        models.append(fit_linear(x, earlier, targets[:, k], everyone))
        earlier = np.column_stack([earlier, out])
    order = np.argsort(-out)
    hits = np.cumsum(targets[order, -1])
    f1 = 2 * hits / (np.arange(1, n + 1) + max(targets[:, -1].sum(), 1))
    best = int(np.argmax(f1))
    next_lower = out[order[best + 1]] if best + 1 < n else 0.0
    return {"models": [(w.astype("f4"), d) for w, d in models], "threshold": float((out[order[best]] + next_lower) / 2), "f1": float(f1[best])}


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and targets of a bounded, digest-ordered sample of labelled documents."""
    plain = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
             .where("toxic = most").select(F.col("doc_id").alias("__id"), "toxic"))
    sample = plain.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(train_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "toxic", "text")
    # Rows that repeat a doc_id could pass the bound: one row of each is enough.
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed()
        for batch in batches:
            out = []
            for doc_id, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                out.append({"doc_id": doc_id, "insult": int(toxic and bool(words & set(INSULTS))), "demeaning": int(toxic and bool(words & set(DEMEANING))),
                            "toxic": int(toxic), "x": features(text.as_py(), hashed).astype("<u2").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("insult", pa.int32()), ("demeaning", pa.int32()), ("toxic", pa.int32()), ("x", pa.binary())]))
    rows = found.mapInArrow(featured, "doc_id bigint, insult int, demeaning int, toxic int, x binary").dropDuplicates(["doc_id"]).limit(train_rows).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [np.frombuffer(r.x, dtype="<u2").astype(np.int64) for r in rows], np.array([[r.insult, r.demeaning, r.toxic] for r in rows], dtype=float).reshape(-1, 3)


def toxicity_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, insult, demeaning and toxic probabilities, is_toxic."""
    rows, targets = training_rows(docs, labels, train_rows)
    usable = len(rows) and 0 < targets[:, -1].sum() < len(rows)
    chain = fit_chain(rows, targets) if usable else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed()
        for batch in batches:
            out = []
            for text in batch.column(1):
                found, p = features(text.as_py(), hashed), []
                if chain and len(found):
                    for w, d in chain["models"]:
                        p.append(float(_sigmoid(w[found].sum(dtype=float) + np.dot([*p, 1.0], d))))
                out.append(p or [0.0] * len(CHAIN))
            columns = [pa.array([round(p[k], 9) for p in out], pa.float64()) for k in range(len(CHAIN))]
            flag = pa.array([bool(chain) and p[-1] >= chain["threshold"] and p[-1] > 0 for p in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, flag], names=["doc_id", *CHAIN, "is_toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, insult double, demeaning double, toxic double, is_toxic boolean")
