"""Trees from shared histograms: all cohorts, folds and candidates of a search grow in the same passes over the data.

A regression tree needs the rows of a node only through sums by feature and bin. One pass over blocks of binned rows adds
up these sums for every node that is being split, of every tree of every fit (cohort, left-out fold, candidate); the
groups that merge them return the best split of each node, and only those reach the driver. So a search of 30 candidates
with five folds costs as many passes as its deepest tree has levels, not a training job per fit. Fits that differ only in
depth (single trees) or in the number of rounds (boosting) are prefixes of one growth and share it.

Boosting is second-order: trees fit gradients with the hessian as weight (one each for squared loss), leaves are shrunk by
``l2``. Shapes: ``level`` splits every node down to ``depth``; ``leaves`` keeps of these splits the ``leaves - 1`` that a
best-first growth would have made; ``symmetric`` gives all nodes of a level the split with the largest common gain.

A forest (``bagged``) is a growth whose trees all fit the labels, each over a bootstrap sample: a row counts as often as a Poisson draw of its
key and the round says. Its prediction is the mean of its trees.

Small fits: where a fit's training rows are at most ``WHOLE_ROWS`` (and ``WHOLE_BYTES`` of codes), the passes would cost more than
the work. Its rows go to one group once, which grows all its trees with the same functions; the groups of the other fits, folds and
candidates run beside it. Larger fits grow in passes, with equal results.

Few distinct rows: a tree sees a row only through its bins, so rows of a cohort with the same bins (a cell) are one row with a count
and a sum of labels. Small fits of several rounds grow so in their group. Where a cohort has at most ``CELL_ROWS`` cells and ``CELL_SHARE`` rows for each, its fits grow from the cells,
a group each: one pass counts them, one scores every row against its own label. Models that sample rows need counts and
sums of every round's sample; these come from one pass too, in which the rows of a cell meet in one task, and reach the group of a fit
sorted by round, a chunk of rounds at a time. The work that grows with the
rows is then a pass or two per search, not one per level and round, with equal results.

Deep single trees: a node with at most ``LOCAL_ROWS`` training rows is finished by one group, which receives its rows once,
grows the rest level by level with the same split function, scores the rows that are to be scored, and returns sums of
errors; only final fits return nodes. The left-out and test rows of a node are hash shares, so they are as bounded as it is.

Scores of the earlier trees are kept beside the rows and written anew every ``REFRESH`` rounds, so no pass walks more
trees than that. Blocks and scores lie in the shared scratch folder: a lost executor costs the passes it was in.

Defined cases: rows without split or fold count only in the scores of final fits; rows without label are left out by the
caller. A feature with one value is never split. A cohort without training rows has no fit (``Grown`` lacks its key).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import collect_bounded, discard, materialize, narrow_batches
from cohortwise.operators.split import CODE
from cohortwise.operators.stats import profile, stacked

FINAL = -1
BINS = 32
BLOCK_ROWS = 16_384
#: Histogram cells (node, feature, bin) of one pass; nodes beyond that wait for the next one.
CELLS = 3_000_000
#: Training rows of a node that one group finishes.
LOCAL_ROWS = 4096
#: Training rows and bytes of codes of a fit that one group grows as a whole.
WHOLE_ROWS, WHOLE_BYTES = 400_000, 32_000_000
#: Most cells of a cohort whose fits grow from cells, and rows a cell must have on average.
CELL_ROWS, CELL_SHARE = 250_000, 4
#: Bytes of all rounds' sums of a fit that samples rows, and of the rounds that its group holds at once; bytes of predictions of one scoring pass;
#: rows, and bytes of sums, of one task of samples.
SAMPLE_BYTES, CHUNK_BYTES, SCORE_BYTES, PART_ROWS, PART_BYTES = 256_000_000, 8_000_000, 64_000_000, 1_000_000, 32_000_000
#: Histogram cells of a whole fit's level that are looked at at once.
HERE_CELLS = 400_000
#: Bytes of all tasks' sums up to which the driver adds them up itself; beyond, groups of executors do.
COLLECT_BYTES = 8_000_000
#: Nodes whose sums travel in one row, and rows of sums that one group adds up.
PART_NODES, FAN_IN = 64, 64
#: Rounds after which the scores of all rows are written.
REFRESH = 10
SEED = 42


@dataclass(frozen=True)
class Growth:
    """How the trees of one model grow."""

    rounds: int = 1
    depth: int = 10
    step: float = 1.0
    least: int = 1
    l2: float = 0.0
    shape: str = "level"
    leaves: int = 31
    rows: float = 1.0
    columns: float = 1.0
    bins: int = BINS
    seed: int = SEED
    bagged: bool = False

    @property
    def drawn(self) -> bool:
        """Whether every round has its own sample of rows."""
        return self.rows < 1 or self.bagged

    def reached(self, base: float, score: np.ndarray, rounds: int) -> np.ndarray:
        """Predictions from ``score``, the sum of the trees of that many rounds."""
        return base + (score / rounds if self.bagged else score)

    def row_seed(self, r: int) -> int:
        """Which rows the tree of round ``r`` sees, if not all."""
        return self.seed * 1_000_003 + r + 1

    def shared(self) -> "Growth":
        """The growth whose prefix this one is, up to ``rounds`` and, for single trees, ``depth``."""
        return replace(self, rounds=0, depth=0) if self.rounds == 1 and self.shape == "level" and not self.bagged else replace(self, rounds=0)


@dataclass
class Tree:
    """Node arrays; ``left`` is 0 for a leaf, the right child follows the left one. ``split`` is the last bin that goes left."""

    feature: list[int] = field(default_factory=lambda: [0])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.split), np.array(self.left), np.array(self.value)

    def children(self, node: int, feature: int, split: int, gain: float) -> int:
        left = len(self.feature)
        self.feature[node], self.split[node], self.left[node], self.gain[node] = feature, split, left, gain
        for column in (self.feature, self.split, self.left):
            column += [0, 0]
        self.value += [0.0, 0.0]
        self.gain += [0.0, 0.0]
        self.level += [self.level[node] + 1] * 2
        return left

    def value_at(self, node: np.ndarray) -> np.ndarray:
        return np.array(self.value)[node]

    def graft(self, node: int, other: "Tree") -> None:
        """Put ``other`` in the place of a leaf."""
        if not other.left[0]:
            return
        shift, level = len(self.feature) - 1, self.level[node]
        self.feature[node], self.split[node], self.left[node], self.gain[node] = other.feature[0], other.split[0], other.left[0] + shift, other.gain[0]
        self.feature += other.feature[1:]
        self.split += other.split[1:]
        self.left += [x + shift if x else 0 for x in other.left[1:]]
        self.value += other.value[1:]
        self.gain += other.gain[1:]
        self.level += [x + level for x in other.level[1:]]

    def best_first(self, leaves: int) -> "Tree":
        """The part of this tree that the ``leaves - 1`` best splits make, each time the best among the leaves so far."""
        kept, open_ = {0}, [0]
        for _ in range(leaves - 1):
            ready = [n for n in open_ if self.left[n]]
            if not ready:
                break
            node = max(ready, key=lambda n: (self.gain[n], -n))
            open_.remove(node)
            open_ += [self.left[node], self.left[node] + 1]
            kept |= {self.left[node], self.left[node] + 1}
        number = {n: k for k, n in enumerate(sorted(kept))}
        out = Tree([], [], [], [], [], [])
        for n in sorted(kept):
            inner = self.left[n] and self.left[n] in kept
            out.feature.append(self.feature[n] if inner else 0)
            out.split.append(self.split[n] if inner else 0)
            out.left.append(number[self.left[n]] if inner else 0)
            out.value.append(self.value[n])
            out.gain.append(self.gain[n] if inner else 0.0)
            out.level.append(self.level[n])
        return out


def walk(tree: tuple[np.ndarray, ...], codes: np.ndarray, depth: int) -> np.ndarray:
    """Node that each column of ``codes`` (features by rows) reaches within ``depth`` steps."""
    feature, split, left, _ = tree
    node, every = np.zeros(codes.shape[1], dtype=np.int64), np.arange(codes.shape[1])
    for _ in range(depth):
        down = left[node]
        if not down.any():
            break
        node = np.where(down > 0, down + (codes[feature[node], every] > split[node]), node)
    return node


@dataclass
class Fit:
    """One growth in one cohort with one fold left out."""

    number: int
    cohort: str
    growth: Growth
    left_out: int
    rounds: int
    depth: int
    place: int  # among the cohort's fits: row of the stored scores
    base: float
    size: int  # training rows
    trees: list[Tree] = field(default_factory=list)
    stored: int = 0  # trees in the stored scores
    frontier: list[int] = field(default_factory=list)
    allowed: list[int] = field(default_factory=list)
    local: list[int] = field(default_factory=list)  # nodes that groups finish
    keep: bool = True  # whether a group keeps the trees that it grew

    @property
    def single(self) -> bool:
        return self.rounds == 1 and self.growth.shape == "level" and not self.growth.bagged

    def columns(self, r: int, features: int) -> list[int]:
        """Features that the tree of round ``r`` may use."""
        rng = np.random.default_rng([self.growth.seed, r])
        return sorted(rng.permutation(features)[:max(1, round(self.growth.columns * features))].tolist())


@dataclass
class Grown:
    """Fitted trees and scores. Keys: (cohort, index into the growths asked for)."""

    fits: dict[tuple[str, int], Fit]
    #: (cohort, index, left-out fold or FINAL, split) to n, mae, rmse, r2; cross-validated ones have the split "cv".
    scores: dict[tuple[str, int, int, str], tuple[int, float, float, float | None]]
    features: dict[str, list[str]]
    edges: dict[tuple[str, str, int], np.ndarray]  # by cohort, feature and number of bins
    passes: int = 0

    def trees(self, cohort: str, index: int, growth: Growth) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(feature, threshold, left, value) of every tree of a final fit, cut to the prefix that ``growth`` asks for."""
        fit, out = self.fits[cohort, index], []
        names = self.features[cohort]
        for tree in fit.trees[:growth.rounds]:
            inner = [bool(left) and level < growth.depth for left, level in zip(tree.left, tree.level)]
            limit = [float(self.edges[cohort, names[f], growth.bins][s]) if i else np.inf for f, s, i in zip(tree.feature, tree.split, inner)]
            out.append((np.array(tree.feature), np.array(limit), np.where(inner, tree.left, 0), np.array(tree.value) / (growth.rounds if growth.bagged else 1)))
        return out

    def importances(self, cohort: str, index: int, growth: Growth) -> list[float]:
        """Shares of the total gain by feature."""
        total = np.zeros(len(self.features[cohort]))
        for tree in self.fits[cohort, index].trees[:growth.rounds]:
            for f, left, gain, level in zip(tree.feature, tree.left, tree.gain, tree.level):
                if left and level < growth.depth:
                    total[f] += gain
        return (total / total.sum() if total.sum() > 0 else total).tolist()


# --- binned blocks -----------------------------------------------------------

def rank_edges(rows: DataFrame, chosen: dict[str, list[str]], cohort: str, bins: int) -> dict[tuple[str, str], np.ndarray]:
    """Upper edges of bins with about equally many training rows, by cohort and feature."""
    features = sorted({f for names in chosen.values() for f in names})
    shares = F.lit([k / bins for k in range(1, bins)])
    ranks = stacked(rows, features, [cohort]).groupBy(cohort, "feature").agg(F.approx_percentile("value", shares, F.lit(100 * bins)).alias("values"))
    return _edges(ranks.select(cohort, "feature", F.explode("values").alias("value")), chosen, cohort)


def width_edges(rows: DataFrame, chosen: dict[str, list[str]], cohort: str, bins: int) -> dict[tuple[str, str], np.ndarray]:
    """Upper edges of bins of equal width between the smallest and the largest training value."""
    features = sorted({f for names in chosen.values() for f in names})
    steps = F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("k")
    wide = profile(rows, features, [cohort]).select(cohort, "feature", "minimum", "maximum", steps)
    return _edges(wide.select(cohort, "feature", (F.col("minimum") + F.col("k") * ((F.col("maximum") - F.col("minimum")) / F.lit(float(bins)))).alias("value")), chosen, cohort)


def _edges(table: DataFrame, chosen, cohort: str) -> dict[tuple[str, str], np.ndarray]:
    found: dict[tuple[str, str], set[float]] = {}
    for r in collect_bounded(table.where(F.col("value").isNotNull())):
        found.setdefault((r[cohort], r.feature), set()).add(float(r.value))
    return {(c, f): np.array(sorted(found.get((c, f), ()))) for c, names in chosen.items() for f in names}


_BLOCK = "cohort string, n int, codes binary, label binary, fold binary, split binary, key binary, stored binary"
_SPLITS = {"train": 0, "test": 1}
_BLOCK_ARROW = pa.schema([("cohort", pa.string()), ("n", pa.int32()), *((c, pa.binary()) for c in ("codes", "label", "fold", "split", "key", "stored"))])


def _blocker(features: list[str], chosen, edges):
    """(cohort, label, split, fold, key, features...) to ``_BLOCK`` rows."""
    def block(cohort: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        label, split, fold, key, *values = (np.concatenate(x) for x in zip(*parts))
        codes = np.stack([np.searchsorted(edges[cohort, f], values[features.index(f)], side="left").astype(np.uint8) for f in chosen[cohort]]) if chosen[cohort] else np.empty((0, len(label)), np.uint8)
        row = [cohort, len(label), codes.tobytes(), label.tobytes(), fold.astype(np.int16).tobytes(), split.astype(np.int8).tobytes(), key.tobytes(), b""]
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            cohorts = np.array(batch.column(0).to_pylist(), dtype=object)
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)]
            for cohort in set(cohorts.tolist()) & set(chosen):
                at = np.flatnonzero(cohorts == cohort)
                held.setdefault(cohort, []).append([c[at] for c in columns])
                sizes[cohort] = sizes.get(cohort, 0) + len(at)
                if sizes[cohort] >= BLOCK_ROWS:
                    yield block(cohort, held.pop(cohort))
                    sizes.pop(cohort)
        for cohort, parts in held.items():
            yield block(cohort, parts)
    return run


def blocks_of(rows: DataFrame, target: str, cohort: str, chosen: dict[str, list[str]], edges) -> DataFrame:
    """Rows as packed blocks of one cohort each: a byte per feature."""
    features = sorted({f for names in chosen.values() for f in names})
    code = F.lit(2)
    for name, number in _SPLITS.items():
        code = F.when(F.col("split") == name, number).otherwise(code)
    wide = rows.select(F.col(cohort), F.col(target).cast("double"), code.cast("int"), F.coalesce(F.col("fold").cast("int"), F.lit(-2)),
                       F.col(CODE) if CODE in rows.columns else F.xxhash64("row_key"), *[F.col(f).cast("double") for f in features])
    with narrow_batches(wide):
        return materialize(wide.toDF(*(f"c{k}" for k in range(len(wide.columns)))).mapInArrow(_blocker(features, chosen, edges), _BLOCK), "blocks")


class _Block:
    """One decoded block in a task."""

    def __init__(self, row: dict, features: int):
        n = row["n"]
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.n, self.cohort, self.codes = n, row["cohort"], read("codes", np.uint8).reshape(features, n)
        self.label, self.fold, self.split, self.key = read("label", np.float64), read("fold", np.int16), read("split", np.int8), read("key", np.int64).view(np.uint64)
        self.stored = read("stored", np.float64).reshape(-1, n)
        self._train: dict[int, np.ndarray] = {}

    def train(self, left_out: int) -> np.ndarray:
        if left_out not in self._train:
            keep = self.split == 0
            self._train[left_out] = np.flatnonzero(keep if left_out == FINAL else keep & (self.fold != left_out))
        return self._train[left_out]

    def score(self, fit: "_Sent", at: np.ndarray) -> np.ndarray:
        """Prediction so far for the rows ``at``."""
        out = self.stored[fit.place, at].copy() if len(self.stored) else np.full(len(at), fit.base)
        codes = self.codes[:, at]
        for tree in fit.recent:
            out += tree[3][walk(tree, codes, fit.depth)]
        return out


@dataclass
class _Sent:
    """What tasks need to know of a fit."""

    number: int
    left_out: int
    place: int
    base: float
    depth: int
    share: float
    seed: int
    allowed: list[int]
    recent: list[tuple[np.ndarray, ...]]
    tree: tuple[np.ndarray, ...] | None = None
    slots: np.ndarray | None = None
    limits: tuple[tuple[int, int], ...] = ()
    level: np.ndarray | None = None
    bagged: bool = False


def _drawn(key: np.ndarray, seed: int) -> np.ndarray:
    """A number below 2**53 for every key."""
    x = (key ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB) >> np.uint64(11)


def _sampled(key: np.ndarray, share: float, seed: int) -> np.ndarray:
    """A fixed share of the rows by their keys."""
    return _drawn(key, seed) < np.uint64(int(share * 2**53))


#: Draws below the k-th of these count a row at most k times: the distribution of Poisson's law with mean 1.
_TIMES = np.array([int(2**53 * p) for p in np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(18)])], dtype=np.uint64)


def _times(key: np.ndarray, seed: int) -> np.ndarray:
    """How often the bootstrap sample of a tree has each row."""
    return np.searchsorted(_TIMES, _drawn(key, seed), side="right")


# --- passes ------------------------------------------------------------------

_SUMS = "fit int, part int, salt int, sums binary"
_SUMS_ARROW = pa.schema([("fit", pa.int32()), ("part", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])


def _decoded(batches: Iterator[pa.RecordBatch], features: dict[str, int], only=None) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            if only is None or row["cohort"] in only:
                yield _Block(row, features[row["cohort"]])


def _summer(sent, features: dict[str, int], bins: int, part_nodes: dict[int, int], salts: int):
    """Sums of counts and gradients by (fit, node, feature, bin)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, list[_Sent]] = sent.value
        totals: dict[int, np.ndarray] = {}
        salt = 0
        for block in _decoded(batches, features):
            salt = int(block.key[:1].sum() % np.uint64(salts)) if not totals else salt
            for fit in plan.get(block.cohort, ()):
                at, times = block.train(fit.left_out), None
                if fit.share < 1:
                    at = at[_sampled(block.key[at], fit.share, fit.seed)]
                if fit.bagged:
                    times = _times(block.key[at], fit.seed)
                    at, times = at[times > 0], times[times > 0]
                codes = block.codes[:, at]
                slot = fit.slots[walk(fit.tree, codes, fit.depth)]
                rest = (block.label[at] - fit.base) * times if fit.bagged else block.label[at] - block.score(fit, at)
                on = slot >= 0
                if not on.all():
                    slot, rest, codes, times = slot[on], rest[on], codes[:, on], None if times is None else times[on]
                count = int(fit.slots.max()) + 1
                if fit.number not in totals:
                    totals[fit.number] = np.zeros((count, len(fit.allowed), bins, 2))
                into = totals[fit.number]
                for k, feature in enumerate(fit.allowed):
                    cell = slot * bins + codes[feature]
                    into[:, k, :, 0] += np.bincount(cell, times, minlength=count * bins).reshape(count, bins)
                    into[:, k, :, 1] += np.bincount(cell, rest, minlength=count * bins).reshape(count, bins)
        for number, sums in totals.items():
            size = part_nodes[number]
            for part in range(0, len(sums), size):
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((number, part // size, salt, sums[part:part + size].tobytes()), _SUMS_ARROW)], schema=_SUMS_ARROW)
    return run


def _added(rows: pd.DataFrame) -> np.ndarray:
    total = np.frombuffer(rows["sums"].iloc[0], dtype=np.float64).copy()
    for sums in rows["sums"].iloc[1:]:
        total += np.frombuffer(sums, dtype=np.float64)
    return total


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"fit": rows["fit"].iloc[0], "part": rows["part"].iloc[0], "salt": 0, "sums": _added(rows).tobytes()}])


def best_splits(sums: np.ndarray, least: int, l2: float, common: bool) -> tuple[np.ndarray, ...]:
    """(gain, feature place, last left bin, count left, gradient left, count, gradient) per node of ``sums``
    (nodes, features, bins, 2); ``common`` gives all nodes the split with the largest summed gain. No split: gain 0."""
    n, s = sums[:, 0, :, 0].sum(axis=1), sums[:, 0, :, 1].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    nl, sl = left[..., 0], left[..., 1]
    nr, sr = n[:, None, None] - nl, s[:, None, None] - sl
    part = lambda a, b: np.divide(a * a, b + l2, out=np.zeros_like(a), where=b + l2 > 0)
    gain = part(sl, nl) + part(sr, nr) - part(s, n)[:, None, None]
    allowed = (nl >= least) & (nr >= least) & (nl > 0) & (nr > 0)
    gain = np.where(allowed, gain, 0.0 if common else -np.inf)
    if common:
        gain = np.where(gain > 0, gain, 0.0)
        pick = np.full(len(n), int(np.argmax(gain.sum(axis=0))))
    else:
        pick = np.argmax(gain.reshape(len(n), -1), axis=1)
    feature, split = np.divmod(pick, gain.shape[2])
    each = np.arange(len(n))
    best = gain[each, feature, split]
    spread = sums[:, 0, :, 1].__abs__().sum(axis=1)  # rounding noise is no gain
    best = np.where(np.isfinite(best) & (best > 1e-12 * np.maximum(1.0, spread * spread / np.maximum(n, 1))), best, 0.0)
    return best, feature, split, nl[each, feature, split], sl[each, feature, split], n, s


_SPLIT_SCHEMA = "fit int, slot int, gain double, feature int, split int, n_left double, s_left double, n double, s double"


def _splitter(rules: dict[int, tuple[int, int, float, bool, int]], bins: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number, part = int(rows["fit"].iloc[0]), int(rows["part"].iloc[0])
        columns, least, l2, common, size = rules[number]
        sums = _added(rows).reshape(-1, columns, bins, 2)
        names = [c.split()[0] for c in _SPLIT_SCHEMA.split(", ")]
        gain, feature, split, nl, sl, n, s = best_splits(sums, least, l2, common)
        slot = part * size + np.arange(len(sums))
        return pd.DataFrame(dict(zip(names, (np.full(len(sums), number), slot, gain, feature, split, nl, sl, n, s))))
    return run


def _scorer(sent, features: dict[str, int]):
    """Sums of errors by (fit, limit, split): for left-out folds the fold's rows, for final fits every row."""
    schema = pa.schema([("fit", pa.int32()), ("lim", pa.int32()), ("split", pa.int32()), *((c, pa.float64()) for c in ("n", "a", "e", "y", "yy"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, list[_Sent]] = sent.value
        totals: dict[tuple[int, int, int], np.ndarray] = {}
        for block in _decoded(batches, features):
            for fit in plan.get(block.cohort, ()):
                groups = {s: np.flatnonzero(block.split == s) for s in (0, 1, 2)} if fit.left_out == FINAL else {
                    9: np.flatnonzero((block.split == 0) & (block.fold == fit.left_out))}
                for split, at in groups.items():
                    if not len(at):
                        continue
                    y = block.label[at]
                    for k, (rounds, depth) in enumerate(fit.limits):
                        if fit.slots is None:
                            error, shifted = block.score(fit, at) - y, y - fit.base
                            if fit.bagged:
                                error = (error + shifted) / rounds - shifted
                        else:  # a prefix of a single tree; what groups finish is scored there
                            node = walk(fit.tree, block.codes[:, at], depth)
                            here = (fit.slots[node] < 0) | (fit.level[node] >= depth)
                            shifted = y[here] - fit.base
                            error = fit.tree[3][node[here]] - shifted
                        total = totals.setdefault((fit.number, k, split), np.zeros(5))
                        total += (len(error), np.abs(error).sum(), (error * error).sum(), shifted.sum(), (shifted * shifted).sum())
        if totals:
            keys, values = np.array(list(totals)), np.array(list(totals.values()))
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, k], pa.int32()) for k in range(3)), *(pa.array(values[:, k].copy()) for k in range(5))], schema=schema)
    return run


def grow_here(codes: np.ndarray, rest: np.ndarray, least: int, l2: float, depth: int, bins: int, common: bool = False, weight: np.ndarray | None = None) -> Tree:
    """A whole tree of few rows, level by level; with ``weight`` a row stands for so many, and ``rest`` holds their sums."""
    tree, frontier, node = Tree(), np.array([0]), np.zeros(len(rest), dtype=np.int64)
    count = len(rest) if weight is None else float(weight.sum())
    tree.value[0] = rest.sum() / (count + l2) if count + l2 > 0 else 0.0
    if count < max(2, 2 * least):
        return tree
    for level in range(depth):
        slots = np.full(len(tree.left), -1)
        slots[frontier] = np.arange(len(frontier))
        on = np.flatnonzero(slots[node] >= 0)
        if not len(on):
            break
        slot, after = slots[node[on]], []
        step = len(frontier) if common else max(1, HERE_CELLS // max(1, len(codes) * bins))
        if step < len(frontier):
            order = np.argsort(slot, kind="stable")
            on, slot = on[order], slot[order]
        for first in range(0, len(frontier), step):
            nodes = frontier[first:first + step]
            few = slice(*np.searchsorted(slot, (first, first + len(nodes)))) if step < len(frontier) else slice(None)
            at, place, sums = on[few], slot[few] - first, np.zeros((len(nodes), len(codes), bins, 2))
            for k in range(len(codes)):
                cell = place * bins + codes[k, at]
                sums[:, k, :, 0] = np.bincount(cell, None if weight is None else weight[at], minlength=len(nodes) * bins).reshape(-1, bins)
                sums[:, k, :, 1] = np.bincount(cell, rest[at], minlength=len(nodes) * bins).reshape(-1, bins)
            for parent, gain, feature, split, nl, sl, n, s in zip(nodes.tolist(), *(x.tolist() for x in best_splits(sums, least, l2, common))):
                if gain > 0:
                    left = tree.children(parent, feature, split, gain)
                    tree.value[left], tree.value[left + 1] = sl / (nl + l2), (s - sl) / (n - nl + l2)
                    after += [child for child, m in ((left, nl), (left + 1, n - nl)) if m >= max(2, 2 * least)]
        if not after:
            break
        node[on] = walk(tree.arrays(), codes[:, on], level + 1) if level == 0 else _one_step(tree.arrays(), codes[:, on], node[on])
        frontier = np.array(after)
    return tree


def _one_step(tree: tuple[np.ndarray, ...], codes: np.ndarray, node: np.ndarray) -> np.ndarray:
    feature, split, left, _ = tree
    down = left[node]
    return np.where(down > 0, down + (codes[feature[node], np.arange(len(node))] > split[node]), node)


_ROWS = "fit int, node int, codes binary, rest binary, role binary"
_ROWS_ARROW = pa.schema([("fit", pa.int32()), ("node", pa.int32()), ("codes", pa.binary()), ("rest", pa.binary()), ("role", pa.binary())])


def _dealer(sent, features: dict[str, int]):
    """Rows of the nodes that groups finish; role is the split, or 9 for the left-out fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, list[_Sent]] = sent.value
        for block in _decoded(batches, features):
            for fit in plan.get(block.cohort, ()):
                role = block.split.copy()
                if fit.left_out != FINAL:
                    role = np.where(role > 0, -1, np.where(block.fold == fit.left_out, 9, 0)).astype(np.int8)
                node = walk(fit.tree, block.codes, fit.depth)
                at = np.flatnonzero((role >= 0) & (fit.slots[node] >= 0))
                at = at[np.argsort(node[at], kind="stable")]
                cuts = np.flatnonzero(np.diff(node[at], prepend=-1))
                for part in np.split(at, cuts[1:]) if len(at) else ():
                    row = (fit.number, int(node[part[0]]), block.codes[:, part].tobytes(), (block.label[part] - fit.base).tobytes(), role[part].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _ROWS_ARROW)], schema=_ROWS_ARROW)
    return run


def grow_fit(fit: Fit, codes: np.ndarray, label: np.ndarray, role: np.ndarray, key: np.ndarray, bins: int, limits) -> Iterator[tuple]:
    """All trees of a fit: (limit, role, sums of errors) as they fall due; the trees end up in ``fit``."""
    g, learn = fit.growth, np.flatnonzero(role == 0)
    roles = [r for r in np.unique(role).tolist() if (r != 9) == (fit.left_out == FINAL)]
    if (fit.rounds > 1 or g.bagged) and (found := _alike(codes)) is not None:
        first, place = found
        sums, shifted = _row_sums(fit, place[learn], (label - fit.base)[learn], key[learn], len(first)), label - fit.base
        for k, reached in grow_cells(fit, codes[:, first], fit.base, bins, limits, sums):
            for split in roles:
                mine = role == split
                error, y = reached[place[mine]] - label[mine], shifted[mine]
                yield k, split, float(len(y)), np.abs(error).sum(), (error * error).sum(), y.sum(), (y * y).sum()
        return
    score = np.full(len(label), fit.base)
    for r in range(fit.rounds):
        allowed = fit.columns(r, len(codes))
        at, times = learn[_sampled(key[learn], g.rows, g.row_seed(r))] if g.rows < 1 else learn, None
        if g.bagged:
            times = _times(key[at], g.row_seed(r)).astype(float)
            at, times = at[times > 0], times[times > 0]
        rest = (label[at] - fit.base) * times if g.bagged else label[at] - score[at]
        tree = grow_here(codes[allowed][:, at], rest, g.least, g.l2, fit.depth, bins, g.shape == "symmetric", times)
        tree.feature = [allowed[f] if down else 0 for f, down in zip(tree.feature, tree.left)]
        if g.shape == "leaves":
            tree = tree.best_first(g.leaves)
        tree.value = [g.step * v for v in tree.value]
        if fit.keep:
            fit.trees.append(tree)
        arrays = tree.arrays()
        if not fit.single:
            score += arrays[3][walk(arrays, codes, fit.depth)]
        for k, (rounds, depth) in enumerate(limits):
            if rounds == r + 1:
                reached = score + arrays[3][walk(arrays, codes, depth)] if fit.single else g.reached(fit.base, score - fit.base, rounds) if g.bagged else score
                for split in roles:
                    mine = role == split
                    error, y = (reached - label)[mine], label[mine] - fit.base
                    yield k, split, float(len(y)), np.abs(error).sum(), (error * error).sum(), y.sum(), (y * y).sum()


def _alike(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A row of every cell and the cell of every row, if there are few."""
    sizes = [int(c.max(initial=0)) + 1 for c in codes]
    if np.prod([float(x) for x in sizes]) >= 2**62:
        return None
    _, first, place = np.unique(_numbers(codes, sizes), return_index=True, return_inverse=True)
    return (first, place) if len(first) * CELL_SHARE <= codes.shape[1] else None


def _row_sums(fit: Fit, place: np.ndarray, shifted: np.ndarray, key: np.ndarray, count: int) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """Counts and sums by cell of the sample of a round, from the rows a fit learns from."""
    g = fit.growth
    every = np.bincount(place, minlength=count).astype(float), np.bincount(place, shifted, minlength=count)

    def sums(r: int) -> tuple[np.ndarray, np.ndarray]:
        if g.bagged:
            times = _times(key, g.row_seed(r))
            if g.rows < 1:
                times *= _sampled(key, g.rows, g.row_seed(r))
            return np.bincount(place, times, minlength=count), np.bincount(place, times * shifted, minlength=count)
        at = np.flatnonzero(_sampled(key, g.rows, g.row_seed(r)))
        return np.bincount(place[at], minlength=count).astype(float), np.bincount(place[at], shifted[at], minlength=count)
    return sums if g.drawn else lambda r: every


def _whole_dealer(sent, features: dict[str, int]):
    """Every row that a fit learns from or is scored on, by fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, list[tuple[int, int]]] = sent.value
        for block in _decoded(batches, features):
            for number, left_out in plan.get(block.cohort, ()):
                role = block.split.copy()
                if left_out != FINAL:
                    role = np.where(role > 0, -1, np.where(block.fold == left_out, 9, 0)).astype(np.int8)
                at = np.flatnonzero(role >= 0)
                row = (number, block.codes[:, at].tobytes(), block.label[at].tobytes(), role[at].tobytes(), block.key[at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _WHOLE_ARROW)], schema=_WHOLE_ARROW)
    return run


_WHOLE = "fit int, codes binary, label binary, role binary, key binary"
_WHOLE_ARROW = pa.schema([("fit", pa.int32()), ("codes", pa.binary()), ("label", pa.binary()), ("role", pa.binary()), ("key", pa.binary())])


def _whole_grower(fits: dict[int, tuple[Fit, tuple]], features: dict[str, int], bins: int):
    names = [c.strip().split(" ")[0] for c in _FINISHED.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fit, limits = fits[int(rows["fit"].iloc[0])]
        read = lambda name, kind: np.frombuffer(b"".join(rows[name]), dtype=kind)
        codes = np.concatenate([np.frombuffer(c, dtype=np.uint8).reshape(features[fit.cohort], -1) for c in rows["codes"]], axis=1)
        out = [(fit.number, 0, *sums, *[None] * 6) for sums in grow_fit(fit, codes, read("label", np.float64), read("role", np.int8), read("key", np.uint64), bins, limits)]
        if fit.left_out == FINAL:
            out += [(fit.number, r, -1, -1, *[0.0] * 5, t.feature, t.split, t.left, t.value, t.gain, t.level) for r, t in enumerate(fit.trees)]
        return pd.DataFrame(out, columns=names)
    return run


_FINISHED = ("fit int, node int, lim int, split int, n double, a double, e double, y double, yy double, "
             "feature array<int>, bin array<int>, down array<int>, value array<double>, gain array<double>, level array<int>")


def _finisher(rules: dict[int, tuple], bins: int):
    names = [c.strip().split(" ")[0] for c in _FINISHED.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number, at = int(rows["fit"].iloc[0]), int(rows["node"].iloc[0])
        columns, least, l2, step, depth, limits, levels, final = rules[number]
        level = levels[at]
        codes = np.concatenate([np.frombuffer(c, dtype=np.uint8).reshape(columns, -1) for c in rows["codes"]], axis=1)
        rest = np.frombuffer(b"".join(rows["rest"]), dtype=np.float64)
        role = np.frombuffer(b"".join(rows["role"]), dtype=np.int8)
        learn = role == 0
        tree = grow_here(codes[:, learn], rest[learn], least, l2, depth - level, bins)
        tree.value = [step * v for v in tree.value]
        out, arrays = [], tree.arrays()
        for split in np.unique(role).tolist():
            if (split == 9) == final:
                continue
            mine = role == split
            y = rest[mine]
            for k, (_, limit) in enumerate(limits):
                if limit > level:
                    error = tree.value_at(walk(arrays, codes[:, mine], limit - level)) - y
                    out.append((number, at, k, split, float(len(y)), np.abs(error).sum(), (error * error).sum(), y.sum(), (y * y).sum(), *[None] * 6))
        if final:
            out.append((number, at, -1, -1, *[0.0] * 5, tree.feature, tree.split, tree.left, tree.value, tree.gain, tree.level))
        return pd.DataFrame(out, columns=names)
    return run


# --- cells: rows with the same bins -------------------------------------------

@dataclass
class _Cells:
    """Distinct rows of bins of one cohort: their numbers, and by fold (``fold + 2``) the training rows and the sums of their labels less ``center``."""

    sizes: tuple[int, ...]  # bins by feature
    keys: np.ndarray
    n: np.ndarray
    s: np.ndarray
    center: float

    def codes(self) -> np.ndarray:
        out, rest = np.empty((len(self.sizes), len(self.keys)), np.uint8), self.keys.copy()
        for k in range(len(self.sizes) - 1, -1, -1):
            rest, out[k] = np.divmod(rest, self.sizes[k])
        return out

    def without(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums outside a fold."""
        keep = np.arange(len(self.n)) != fold + 2 if fold != FINAL else np.ones(len(self.n), bool)
        return self.n[keep].sum(axis=0), self.s[keep].sum(axis=0)


def _numbers(codes: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """One number for the bins of each row."""
    key = np.zeros(codes.shape[1], np.int64)
    for code, size in zip(codes, sizes):
        key = key * size + code
    return key


_CELL = "cohort string, cell bigint, fold int, n double, s double"
_CELL_ARROW = pa.schema([("cohort", pa.string()), ("cell", pa.int64()), ("fold", pa.int32()), ("n", pa.float64()), ("s", pa.float64())])


def _cell_counter(sizes: dict[str, tuple[int, ...]], folds: int, centers: dict[str, float], most: dict[str, int]):
    """Training rows and sums of labels by cell and fold; a cohort with more cells than ``most`` sends the cell -1 instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes_held: dict[str, list[int]] = {}  # rows held, and cells when they were last added up
        over: set[str] = set()

        def add_up(c: str) -> None:
            key, n, s = (np.concatenate(x) for x in zip(*held[c]))
            key, place = np.unique(key, return_inverse=True)
            held[c], sizes_held[c] = [(key, np.bincount(place, n), np.bincount(place, s))], [len(key), len(key)]
            if len(key) > most[c] and len(np.unique(key // folds)) > most[c]:
                over.add(c)
                held[c] = [(np.array([-folds]), np.zeros(1), np.zeros(1))]

        for block in _decoded(batches, {c: len(x) for c, x in sizes.items()}, sizes):
            c = block.cohort
            if c in over:
                continue
            train = block.split == 0
            key = _numbers(block.codes, sizes[c]) * folds + np.where(train, block.fold + 2, 0)
            held.setdefault(c, []).append((key, train.astype(float), np.where(train, block.label - centers[c], 0.0)))
            size = sizes_held.setdefault(c, [0, 0])
            size[0] += block.n
            if size[0] > 2 * size[1] + 4 * BLOCK_ROWS:
                add_up(c)
        for c in [c for c in held if c not in over]:
            add_up(c)
        for c, ((key, n, s),) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(key)), pa.array(key // folds), pa.array((key % folds).astype(np.int32)), pa.array(n), pa.array(s)], schema=_CELL_ARROW)
    return run


def _placed(cells: _Cells, block: _Block) -> np.ndarray:
    """Cell of every row of a block."""
    return np.searchsorted(cells.keys, _numbers(block.codes, cells.sizes))


_SAMPLED = "part int, cohort string, cell binary, fold binary, key binary, label binary"
_SAMPLED_ARROW = pa.schema([("part", pa.int32()), ("cohort", pa.string()), *((c, pa.binary()) for c in ("cell", "fold", "key", "label"))])


def _sample_dealer(sent, features: dict[str, int]):
    """Training rows by the part that their cell belongs to; a cell of many rows has several parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, tuple[_Cells, np.ndarray, np.ndarray]] = sent.value
        for block in _decoded(batches, features, plan):
            cells, first, span = plan[block.cohort]
            at = block.train(FINAL)
            cell, key = _placed(cells, block)[at].astype(np.int32), block.key[at]
            part = first[cell] + (key % span[cell].astype(np.uint64)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(at) else ():
                row = (int(part[mine[0]]), block.cohort, cell[mine].tobytes(), (block.fold[at][mine] + 2).astype(np.int32).tobytes(), key[mine].tobytes(), (block.label[at][mine] - cells.center).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _SAMPLED_ARROW)], schema=_SAMPLED_ARROW)
    return run


_ROUND_SUMS = "fit int, chunk int, cell binary, sums binary"


def _chunk_rounds(cells: int) -> int:
    """Rounds whose sums travel together."""
    return max(1, CHUNK_BYTES // (16 * max(1, cells)))


def _sample_counter(fits: dict[str, list[tuple[int, Growth, int]]], folds: int, chunks: dict[str, int]):
    """Counts and sums of labels of every round's sample by fit, chunk of rounds and cell, over the rows of one part.

    The draws of a round are shared by all fits of a seed: they differ in the share of it that they take."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.frombuffer(b"".join(rows[name]), dtype=kind)
        cell, place = np.unique(read("cell", np.int32), return_inverse=True)
        fold, key, label = read("fold", np.int32), read("key", np.uint64), read("label", np.float64)
        group, out = place * folds + fold, []
        mine, chunk = fits[rows["cohort"].iloc[0]], chunks[rows["cohort"].iloc[0]]
        for seed in sorted({g.seed for _, g, _ in mine}):
            of_seed = [f for f in mine if f[1].seed == seed and f[1].bagged]
            bags = {number: np.empty((g.rounds, 2, len(cell))) for number, g, _ in of_seed}
            for r in range(max((g.rounds for _, g, _ in of_seed), default=0)):
                times = _times(key, of_seed[0][1].row_seed(r))
                by_fold = [np.bincount(group, w, minlength=len(cell) * folds).reshape(len(cell), folds) for w in (times, times * label)]
                for number, g, left_out in of_seed:
                    if r < g.rounds:
                        for k in range(2):
                            bags[number][r, k] = by_fold[k].sum(axis=1) - (by_fold[k][:, left_out + 2] if left_out != FINAL else 0)
            out += [(number, r // chunk, cell.astype(np.int32).tobytes(), x[r:r + chunk].tobytes()) for number, x in bags.items() for r in range(0, len(x), chunk)]
            of_seed = [f for f in mine if f[1].seed == seed and not f[1].bagged]
            sums = {number: np.empty((g.rounds, 2, len(cell))) for number, g, _ in of_seed}
            limits = np.array(sorted({int(g.rows * 2**53) for _, g, _ in of_seed}), dtype=np.uint64)
            for r in range(max((g.rounds for _, g, _ in of_seed), default=0)):
                slot = group * (len(limits) + 1) + np.searchsorted(limits, _drawn(key, of_seed[0][1].row_seed(r)), side="right")
                shape = len(cell), folds, len(limits) + 1
                below = [np.bincount(slot, w, minlength=shape[0] * shape[1] * shape[2]).reshape(shape).cumsum(axis=2) for w in (None, label)]
                every = [b.sum(axis=1) for b in below]
                for number, g, left_out in of_seed:
                    if r < g.rounds:
                        share = int(np.searchsorted(limits, np.uint64(int(g.rows * 2**53))))
                        for k in range(2):
                            sums[number][r, k] = every[k][:, share] - (below[k][:, left_out + 2, share] if left_out != FINAL else 0)
            out += [(number, r // chunk, cell.astype(np.int32).tobytes(), x[r:r + chunk].tobytes()) for number, x in sums.items() for r in range(0, len(x), chunk)]
        return pd.DataFrame(out, columns=["fit", "chunk", "cell", "sums"])
    return run


_FROM_CELLS = ("fit int, lim int, reached binary, feature array<int>, bin array<int>, down array<int>, value array<double>, gain array<double>, level array<int>, round int")
_FROM_CELLS_ARROW = pa.schema([("fit", pa.int32()), ("lim", pa.int32()), ("reached", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("feature", "bin", "down")),
                               *((c, pa.list_(pa.float64())) for c in ("value", "gain")), ("level", pa.list_(pa.int32())), ("round", pa.int32())])


def grow_cells(fit: Fit, codes: np.ndarray, center: float, bins: int, limits, sums: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """All trees of a fit from cells: (limit, prediction by cell) as they fall due; the trees end up in ``fit``. ``sums`` gives
    the counts and sums of the labels less ``center`` that a round learns from, by cell."""
    g = fit.growth
    score = np.zeros(codes.shape[1])
    for r in range(fit.rounds):
        n, s = sums(r)
        allowed, at = fit.columns(r, len(codes)), np.flatnonzero(n > 0)
        rest = s[at] + n[at] * (center - fit.base - (0.0 if g.bagged else score[at]))
        tree = grow_here(codes[np.ix_(allowed, at)], rest, g.least, g.l2, fit.depth, bins, g.shape == "symmetric", n[at])
        tree.feature = [allowed[f] if down else 0 for f, down in zip(tree.feature, tree.left)]
        if g.shape == "leaves":
            tree = tree.best_first(g.leaves)
        tree.value = [g.step * v for v in tree.value]
        if fit.keep:
            fit.trees.append(tree)
        arrays = tree.arrays()
        if not fit.single:
            score += arrays[3][walk(arrays, codes, fit.depth)]
        for k, (rounds, depth) in enumerate(limits):
            if rounds == r + 1:
                yield k, fit.base + arrays[3][walk(arrays, codes, depth)] if fit.single else g.reached(fit.base, score, rounds)


def _chunked_sums(rows: Iterator[tuple], rounds: int, chunk: int, count: int) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """Counts and sums of one round after the other from ``rows`` of (fit, chunk, cells, sums) sorted by chunk, of which one is held."""
    parts, held = groupby(rows, key=lambda row: row[1]), {}

    def sums(r: int) -> tuple[np.ndarray, np.ndarray]:
        while r // chunk not in held:
            held.clear()
            number, mine = next(parts)
            table = held[number] = np.zeros((2, min(chunk, rounds - number * chunk), count))
            for _, _, cell, values in mine:
                cell = np.frombuffer(cell, dtype=np.int32)
                table[:, :, cell] += np.frombuffer(values, dtype=np.float64).reshape(table.shape[1], 2, -1).transpose(1, 0, 2)
        return held[r // chunk][0, r % chunk], held[r // chunk][1, r % chunk]
    return sums


def _cell_grower(sent, bins: int, chunks: dict[str, int]):
    """Fits from rows of ``_ROUND_SUMS`` sorted by fit and chunk; a fit without samples has one row without sums."""
    def packed(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _FROM_CELLS_ARROW)], schema=_FROM_CELLS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of, jobs = sent.value
        rows = (tuple(column[k].as_py() for column in batch.columns) for batch in batches for k in range(batch.num_rows))
        for number, mine in groupby(rows, key=lambda row: row[0]):
            fit, limits = jobs[number]
            cells, fit = cells_of[fit.cohort], replace(fit, trees=[])
            if fit.growth.drawn:
                sums = _chunked_sums(mine, fit.rounds, chunks[fit.cohort], len(cells.keys))
            else:
                every = cells.without(fit.left_out)
                sums = lambda r: every
            for k, reached in grow_cells(fit, cells.codes(), cells.center, bins, limits, sums):
                yield packed(number, k, reached.tobytes(), *[None] * 6, -1)
            if fit.left_out == FINAL:
                for r, t in enumerate(fit.trees):
                    yield packed(number, -1, b"", t.feature, t.split, t.left, t.value, t.gain, t.level, r)
    return run


def _cell_scorer(sent, features: dict[str, int]):
    """Sums of errors by (fit, limit, split) of predictions by cell."""
    schema = pa.schema([("fit", pa.int32()), ("lim", pa.int32()), ("split", pa.int32()), *((c, pa.float64()) for c in ("n", "a", "e", "y", "yy"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, tuple[_Cells, list]] = sent.value
        totals: dict[tuple[int, int, int], np.ndarray] = {}
        for block in _decoded(batches, features, plan):
            cells, fits = plan[block.cohort]
            place = _placed(cells, block)
            groups: dict[tuple[int, int], tuple] = {}
            for number, left_out, base, reached in fits:
                for split in (0, 1, 2) if left_out == FINAL else (9,):
                    if (left_out, split) not in groups:
                        at = np.flatnonzero((block.split == 0) & (block.fold == left_out) if split == 9 else block.split == split)
                        groups[left_out, split] = place[at], block.label[at]
                    mine, y = groups[left_out, split]
                    if not len(y):
                        continue
                    shifted = y - base
                    of_labels = shifted.sum(), shifted @ shifted
                    for k, prediction in reached:
                        error = prediction[mine] - y
                        total = totals.setdefault((number, k, split), np.zeros(5))
                        total += (len(y), np.abs(error).sum(), error @ error, *of_labels)
        if totals:
            keys, values = np.array(list(totals)), np.array(list(totals.values()))
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, k], pa.int32()) for k in range(3)), *(pa.array(values[:, k].copy()) for k in range(5))], schema=schema)
    return run


def _storer(sent, features: dict[str, int], counts: dict[str, int]):
    """Blocks with the scores of all trees so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[str, list[_Sent]] = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, features[row["cohort"]])
                stored = block.stored.copy() if len(block.stored) else np.zeros((counts[block.cohort], block.n))
                for fit in plan.get(block.cohort, ()):
                    stored[fit.place] = block.score(fit, np.arange(block.n))
                yield pa.RecordBatch.from_pylist([{**row, "stored": stored.tobytes()}], schema=_BLOCK_ARROW)
    return run


# --- growth ------------------------------------------------------------------

class Grower:
    """Grow ``growths`` for every cohort of ``chosen``; with ``folds`` also once per left-out fold."""

    def __init__(self, rows: DataFrame, target: str, cohort: str, chosen: dict[str, list[str]], edges=rank_edges):
        self.rows, self.target, self.cohort, self.edges_of = rows, target, cohort, edges
        self.chosen = {c: list(names) for c, names in chosen.items() if names}
        self.spark = rows.sparkSession
        self.train = rows.where(F.col("split") == "train")
        self.passes = 0
        self._kept: dict[int, tuple[dict, DataFrame]] = {}
        self._cells: dict[int, dict[str, _Cells]] = {}

    def release(self) -> None:
        """Delete the blocks."""
        for _, blocks in self._kept.values():
            discard(blocks)
        self._kept.clear()
        self._cells.clear()

    def grow(self, growths: Sequence[Growth], folds: bool = True, final: bool = True, cohorts: Sequence[str] | None = None, keep: bool = True) -> Grown:
        """``cohorts``: only these of the chosen ones; without ``keep`` the trees of final fits may be left where they grew: their scores are wanted only."""
        self.keep = keep
        self.wanted = set(self.chosen if cohorts is None else cohorts)
        out = Grown({}, {}, self.chosen, {})
        by_bins: dict[int, list[int]] = {}
        for i, g in enumerate(growths):
            by_bins.setdefault(g.bins, []).append(i)
        for bins, indexes in by_bins.items():
            self._grow(out, growths, indexes, bins, folds, final)
        out.passes = self.passes
        return out

    def _means(self) -> dict[str, dict[int, tuple[float, int]]]:
        """Mean label and number of the training rows by cohort, for each left-out fold and for all rows."""
        sums: dict[str, list] = {}
        for r in collect_bounded(self.train.groupBy(self.cohort, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(self.target).cast("double")).alias("s"))):
            sums.setdefault(r[self.cohort], []).append((r.fold, r.n, r.s))
        self.last_fold = max((p[0] for parts in sums.values() for p in parts if p[0] is not None), default=0)
        means = {}
        for c, parts in sums.items():
            n, s = sum(p[1] for p in parts), sum(p[2] for p in parts)
            means[c] = {FINAL: (s / n, n)}
            for fold, own, total in parts:
                if fold is not None and n > own:
                    means[c][fold] = (s - total) / (n - own), n - own
        return means

    def _grow(self, out: Grown, growths, indexes, bins: int, folds: bool, final: bool) -> None:
        means = self._means()
        chosen = {c: names for c, names in self.chosen.items() if c in means}
        self.features, self.bins = {c: len(names) for c, names in chosen.items()}, bins
        if bins not in self._kept:
            edges = self.edges_of(self.train, self.chosen, self.cohort, bins)
            self._kept[bins] = edges, blocks_of(self.rows, self.target, self.cohort, chosen, edges)
        edges, first = self._kept[bins]
        out.edges.update({(*key, bins): values for key, values in edges.items()})
        blocks = first
        self.tasks = max(1, blocks.rdd.getNumPartitions())
        self.salts = -(-self.tasks // FAN_IN)

        shared: dict[Growth, list[int]] = {}
        for i in indexes:
            shared.setdefault(growths[i].shared(), []).append(i)
        fits, owners = [], {}
        for c in [c for c in chosen if c in self.wanted]:
            place = 0
            for base, members in shared.items():
                rounds, depth = max(growths[i].rounds for i in members), max(growths[i].depth for i in members)
                for left_out in [*sorted(f for f in means[c] if f != FINAL and folds), *([FINAL] if final else [])]:
                    fit = Fit(len(fits), c, replace(growths[members[0]], rounds=rounds, depth=depth), left_out, rounds, depth, place, *means[c][left_out])
                    owners[fit.number] = members
                    place += 1
                    fits.append(fit)
                    if left_out == FINAL:
                        out.fits.update({(c, i): fit for i in members})
        counts = {c: sum(f.cohort == c for f in fits) for c in chosen}
        whole = [f for f in fits if self._is_whole(f.size, f.cohort)]
        if whole:
            self._wholes(out, blocks, whole, owners, growths)
            numbers = {f.number for f in whole}
            fits = [f for f in fits if f.number not in numbers]
        if fits:
            cells = self._cells_of(first, edges, means)
            few = [f for f in fits if f.cohort in cells and (not f.growth.drawn or f.rounds * len(cells[f.cohort].keys) * 16 <= SAMPLE_BYTES)]
            if few:
                self._from_cells(out, blocks, few, owners, growths, cells)
                numbers = {f.number for f in few}
                fits = [f for f in fits if f.number not in numbers]

        for r in range(max((f.rounds for f in fits), default=0)):
            active = [f for f in fits if r < f.rounds]
            for f in active:
                f.trees.append(Tree())
                f.allowed = f.columns(r, self.features[f.cohort])
                f.frontier, f.local = [0], []
            while splitting := [f for f in active if f.frontier]:
                self._level(blocks, splitting)
            for f in active:
                g, tree = f.growth, f.trees[-1]
                if g.shape == "leaves":
                    f.trees[-1] = tree = tree.best_first(g.leaves)
                tree.value = [g.step * v for v in tree.value]
            done = [(f, i) for f in active for i in owners[f.number] if growths[i].rounds == r + 1]
            if done:
                self._score(out, blocks, done, growths)
            going = [f for f in fits if r + 1 < f.rounds]
            if going and (r + 1) % REFRESH == 0:
                sent = self._send(going)
                after = materialize(blocks.mapInArrow(_storer(sent, self.features, counts), _BLOCK), "blocks")
                sent.unpersist()
                if blocks is not first:
                    discard(blocks)
                blocks = after
                for f in going:
                    f.stored = len(f.trees)
        if blocks is not first:
            discard(blocks)

    def _is_whole(self, rows: int, cohort: str) -> bool:
        return rows <= WHOLE_ROWS and rows * self.features[cohort] <= WHOLE_BYTES

    def _apart(self, fits: list[Fit]) -> int:
        """Number of partitions by hash of ``fit`` in which the largest share of the work is least."""
        numbers = self.spark.createDataFrame([(f.number,) for f in fits], "fit int").select("fit", F.hash("fit").alias("h"))
        hashes = {r.fit: r.h for r in collect_bounded(numbers)}
        at, work = np.array([hashes[f.number] for f in fits]), np.array([float(f.rounds * f.depth) for f in fits])
        return min(range(len(fits), 3 * len(fits) + 1), key=lambda count: (np.bincount(at % count, work).max(), count))

    def _wholes(self, out: Grown, blocks: DataFrame, fits: list[Fit], owners, growths) -> None:
        """Grow small fits, a group each."""
        self.passes += 1
        plan: dict[str, list[tuple[int, int]]] = {}
        for f in fits:
            plan.setdefault(f.cohort, []).append((f.number, f.left_out))
        sent = self.spark.sparkContext.broadcast(plan)
        jobs = {f.number: (replace(f, trees=[], keep=f.left_out == FINAL and self.keep), tuple((growths[i].rounds, growths[i].depth) for i in owners[f.number])) for f in fits}
        dealt = blocks.mapInArrow(_whole_dealer(sent, self.features), _WHOLE).repartition(self._apart(fits), "fit")
        found = materialize(dealt.groupBy("fit").applyInPandas(_whole_grower(jobs, self.features, self.bins), _FINISHED), "finished")
        of = {f.number: f for f in fits}
        for r in found.where("lim < 0").orderBy("fit", "node").toLocalIterator():  # trees of final fits, which the models hold anyway
            of[r.fit].trees.append(Tree(list(r.feature), list(r.bin), list(r.down), list(r.value), list(r.gain), list(r.level)))
        for r in collect_bounded(found.where("lim >= 0")):
            self._note(out, of[r.fit], owners[r.fit][r.lim], r)
        discard(found)
        sent.unpersist()

    def _cells_of(self, blocks: DataFrame, edges, means) -> dict[str, _Cells]:
        """Cells of the cohorts that have few; counted once for every number of bins."""
        if self.bins in self._cells:
            return self._cells[self.bins]
        self.passes += 1
        sizes = {c: tuple(len(edges[c, f]) + 1 for f in self.chosen[c]) for c in self.features if not self._is_whole(means[c][FINAL][1], c)}
        folds = self.last_fold + 3
        sizes = {c: x for c, x in sizes.items() if np.prod([float(k) for k in (*x, folds)]) < 2**62}
        most = {c: int(min(CELL_ROWS, means[c][FINAL][1] // CELL_SHARE)) for c in sizes}
        centers = {c: means[c][FINAL][0] for c in sizes}
        counted = materialize(blocks.mapInArrow(_cell_counter(sizes, folds, centers, most), _CELL).groupBy("cohort", "cell", "fold")
                              .agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "cells")
        found = counted.groupBy("cohort").agg(F.min("cell").alias("least"), F.countDistinct("cell").alias("cells"))
        good, total = [], 0
        for r in sorted(collect_bounded(found), key=lambda r: r.cells):
            total += r.cells
            if r["least"] >= 0 and r.cells <= most[r.cohort] and total <= 4 * CELL_ROWS:
                good.append(r.cohort)
        out = {}
        for c in good:
            rows = counted.where(F.col("cohort") == c).toPandas()  # at most CELL_ROWS cells
            keys, place = np.unique(rows["cell"].to_numpy(), return_inverse=True)
            sums = [np.bincount(rows["fold"].to_numpy() * len(keys) + place, rows[x].to_numpy(), minlength=folds * len(keys)).reshape(folds, -1) for x in ("n", "s")]
            out[c] = _Cells(sizes[c], keys, *sums, centers[c])
        discard(counted)
        self._cells[self.bins] = out
        return out

    def _from_cells(self, out: Grown, blocks: DataFrame, fits: list[Fit], owners, growths, cells: dict[str, _Cells]) -> None:
        """Grow fits from cells, a group each, and score all rows by their cells."""
        of = {f.number: f for f in fits}
        jobs = {f.number: (replace(f, trees=[], keep=f.left_out == FINAL and self.keep), tuple((growths[i].rounds, growths[i].depth) for i in owners[f.number])) for f in fits}
        used = {c: cells[c] for c in {f.cohort for f in fits}}
        chunks = {c: _chunk_rounds(len(x.keys)) for c, x in used.items()}
        sent = self.spark.sparkContext.broadcast((used, jobs))
        sampled = [f for f in fits if f.growth.drawn]
        # Fits without samples start from a row without sums.
        starts = self.spark.createDataFrame([(f.number, 0, b"", b"") for f in fits if not f.growth.drawn], _ROUND_SUMS)
        starts = starts if not sampled else starts.unionByName(self._samples(blocks, sampled, used, chunks))
        sorted_ = starts.repartition(self._apart(fits), "fit").sortWithinPartitions("fit", "chunk")
        grown = materialize(sorted_.mapInArrow(_cell_grower(sent, self.bins, chunks), _FROM_CELLS), "grown")
        for r in grown.where("lim < 0").orderBy("fit", "round").toLocalIterator():  # trees of final fits, which the models hold anyway
            of[r.fit].trees.append(Tree(list(r.feature), list(r.bin), list(r.down), list(r.value), list(r.gain), list(r.level)))
        batch, size = [], 0
        for r in grown.where("lim >= 0").select("fit", "lim", "reached").toLocalIterator():
            batch.append((r.fit, r.lim, np.frombuffer(r.reached, dtype=np.float64)))
            size += len(r.reached)
            if size >= SCORE_BYTES:
                self._score_cells(out, blocks, batch, of, owners, used)
                batch, size = [], 0
        if batch:
            self._score_cells(out, blocks, batch, of, owners, used)
        discard(grown)
        sent.unpersist()

    def _samples(self, blocks: DataFrame, fits: list[Fit], cells: dict[str, _Cells], chunks: dict[str, int]) -> DataFrame:
        """Counts and sums by round and cell of the fits that sample rows."""
        self.passes += 1
        plan, start, by_cohort = {}, 0, {}
        for f in fits:
            by_cohort.setdefault(f.cohort, []).append((f.number, replace(f.growth, rounds=f.rounds), f.left_out))
        for c, mine in by_cohort.items():
            n = cells[c].n.sum(axis=0)
            sums = sum(g.rounds for _, g, _ in mine) * 16 * len(n)
            parts = max(1, self.tasks // len(by_cohort), round(n.sum() / PART_ROWS), round(sums / PART_BYTES))
            share = n.sum() / parts
            before = np.cumsum(n) - n
            first = np.minimum(before // share, parts - 1).astype(np.int64)
            span = np.where(n > share, np.minimum((before + n) // share, parts - 1) - first + 1, 1).astype(np.int64)
            plan[c] = cells[c], start + first, span
            start += parts
        sent = self.spark.sparkContext.broadcast(plan)
        folds = max(len(x.n) for x in cells.values())
        dealt = blocks.mapInArrow(_sample_dealer(sent, self.features), _SAMPLED).repartition(start, "part")
        return dealt.groupBy("part").applyInPandas(_sample_counter(by_cohort, folds, chunks), _ROUND_SUMS)

    def _score_cells(self, out: Grown, blocks: DataFrame, batch, of: dict[int, Fit], owners, cells: dict[str, _Cells]) -> None:
        self.passes += 1
        by_fit: dict[int, list] = {}
        for number, k, reached in batch:
            by_fit.setdefault(number, []).append((k, reached))
        plan: dict[str, tuple] = {}
        for number, reached in by_fit.items():
            f = of[number]
            plan.setdefault(f.cohort, (cells[f.cohort], []))[1].append((number, f.left_out, f.base, reached))
        sent = self.spark.sparkContext.broadcast(plan)
        sums = blocks.mapInArrow(_cell_scorer(sent, self.features), "fit int, lim int, split int, n double, a double, e double, y double, yy double")
        for r in collect_bounded(sums.groupBy("fit", "lim", "split").agg(*[F.sum(c).alias(c) for c in ("n", "a", "e", "y", "yy")])):
            self._note(out, of[r.fit], owners[r.fit][r.lim], r)
        sent.unpersist()

    def _note(self, out: Grown, fit: Fit, index: int, r) -> None:
        """Metrics from sums of errors."""
        if not r.n:
            return
        spread = r.yy - r.y * r.y / r.n
        split = {0: "train", 1: "test", 2: None, 9: "cv"}[r.split]
        r2 = 1 - r.e / spread if spread > 1e-12 * max(r.yy, 1e-300) else None
        out.scores[fit.cohort, index, fit.left_out, split] = (int(r.n), r.a / r.n, float(np.sqrt(r.e / r.n)), r2)

    def _sent(self, fit: Fit, growing: bool = False) -> _Sent:
        done = fit.trees[:-1] if growing else fit.trees
        g = fit.growth
        return _Sent(fit.number, fit.left_out, fit.place, fit.base, fit.depth, g.rows, g.row_seed(len(fit.trees) - 1),
                     fit.allowed, [t.arrays() for t in done[fit.stored:]], bagged=g.bagged)

    def _send(self, fits: Sequence[Fit], sent: dict[int, _Sent] | None = None):
        plan: dict[str, list[_Sent]] = {}
        for f in fits:
            plan.setdefault(f.cohort, []).append(sent[f.number] if sent else self._sent(f))
        return self.spark.sparkContext.broadcast(plan)

    def _level(self, blocks: DataFrame, fits: Sequence[Fit]) -> None:
        """Split the frontiers of ``fits``, as many nodes in a pass as ``CELLS`` allows."""
        waiting = [(f, list(f.frontier)) for f in fits]
        for f in fits:
            f.frontier = []
        while waiting:
            batch, room = [], CELLS
            while waiting and (room > 0 or not batch):
                f, nodes = waiting.pop(0)
                each = len(f.allowed) * self.bins
                take = len(nodes) if f.growth.shape == "symmetric" else max(1, min(len(nodes), room // each))
                batch.append((f, nodes[:take]))
                room -= take * each
                if take < len(nodes):
                    waiting.insert(0, (f, nodes[take:]))
                    break
            self._pass(blocks, batch)

    def _pass(self, blocks: DataFrame, batch: list[tuple[Fit, list[int]]]) -> None:
        self.passes += 1
        sent, rules, sizes = {}, {}, {}
        for f, nodes in batch:
            s = self._sent(f, growing=True)
            s.tree = f.trees[-1].arrays()
            s.slots = np.full(len(f.trees[-1].left), -1)
            s.slots[nodes] = np.arange(len(nodes))
            g = f.growth
            sizes[f.number] = len(nodes) if g.shape == "symmetric" else PART_NODES
            rules[f.number] = (len(f.allowed), g.least, g.l2, g.shape == "symmetric", sizes[f.number])
            sent[f.number] = s
        plan = self._send([f for f, _ in batch], sent)
        sums = blocks.mapInArrow(_summer(plan, self.features, self.bins, sizes, self.salts), _SUMS)
        split = _splitter(rules, self.bins)
        if self.tasks * sum(len(nodes) * len(f.allowed) * self.bins * 16 for f, nodes in batch) <= COLLECT_BYTES:
            rows = pd.DataFrame(sums.collect(), columns=sums.columns)
            found = pd.concat([split(part) for _, part in rows.groupby(["fit", "part"])]) if len(rows) else None
        else:
            if self.salts > 1:
                sums = sums.groupBy("fit", "part", "salt").applyInPandas(_add_up, _SUMS)
            found = sums.groupBy("fit", "part").applyInPandas(split, _SPLIT_SCHEMA).toPandas()  # a row per node, bounded by CELLS
        of = {f.number: (f, nodes) for f, nodes in batch}
        for r in found.sort_values(["fit", "slot"]).itertuples(index=False) if found is not None else ():
            f, nodes = of[r.fit]
            tree, node, g = f.trees[-1], nodes[r.slot], f.growth
            leaf = lambda s, n: s / (n + g.l2) if n + g.l2 > 0 else 0.0
            if not node:
                tree.value[0] = leaf(r.s, r.n)
            if r.gain <= 0:
                continue
            left = tree.children(node, f.allowed[int(r.feature)], int(r.split), float(r.gain))
            tree.value[left], tree.value[left + 1] = leaf(r.s_left, r.n_left), leaf(r.s - r.s_left, r.n - r.n_left)
            if tree.level[left] < f.depth:
                for child, n in ((left, r.n_left), (left + 1, r.n - r.n_left)):
                    if n >= max(2, 2 * g.least):
                        (f.local if f.single and n <= LOCAL_ROWS else f.frontier).append(child)
        plan.unpersist()

    def _score(self, out: Grown, blocks: DataFrame, done: list[tuple[Fit, int]], growths) -> None:
        by_fit: dict[int, tuple[Fit, list[int]]] = {}
        for f, i in done:
            by_fit.setdefault(f.number, (f, []))[1].append(i)
        sent, rules = {}, {}
        for f, members in by_fit.values():
            s = self._sent(f)
            s.limits = tuple((growths[i].rounds, growths[i].depth) for i in members)
            if f.single:
                tree = f.trees[0]
                s.tree, s.level, s.slots = tree.arrays(), np.array(tree.level), np.full(len(tree.left), -1)
                s.slots[f.local] = 0
                if f.local:
                    rules[f.number] = (self.features[f.cohort], f.growth.least, f.growth.l2, f.growth.step, f.depth, s.limits, dict(zip(f.local, (tree.level[n] for n in f.local))), f.left_out == FINAL)
            sent[f.number] = s
        plan = self._send([f for f, _ in by_fit.values()], sent)
        keys, sums = ["fit", "lim", "split"], [F.sum(c).alias(c) for c in ("n", "a", "e", "y", "yy")]
        rows = blocks.mapInArrow(_scorer(plan, self.features), "fit int, lim int, split int, n double, a double, e double, y double, yy double")
        if rules:
            self.passes += 1
            local = self._send([by_fit[k][0] for k in rules], sent)
            found = blocks.mapInArrow(_dealer(local, self.features), _ROWS).groupBy("fit", "node").applyInPandas(_finisher(rules, self.bins), _FINISHED)
            found = materialize(found, "finished")
            rows = rows.unionByName(found.where("lim >= 0").select(*rows.columns))
            for r in found.where("lim < 0").orderBy("fit", "node").toLocalIterator():  # nodes of final fits, which the models hold anyway
                by_fit[r.fit][0].trees[0].graft(r.node, Tree(list(r.feature), list(r.bin), list(r.down), list(r.value), list(r.gain), list(r.level)))
        for r in collect_bounded(rows.groupBy(*keys).agg(*sums)):
            f, members = by_fit[r.fit]
            self._note(out, f, members[r.lim], r)
        if rules:
            discard(found)
            local.unpersist()
        plan.unpersist()


# --- scoring as an expression ------------------------------------------------

def prediction_sql(base: float, trees: Sequence[tuple[np.ndarray, ...]], columns: Sequence[str], depth: int) -> str:
    """The model as one SQL expression over ``columns``: flat node arrays, walked without a branch per node.

    A leaf points to itself and has an infinite limit, so every walk takes ``depth`` steps."""
    feature, limit, left, value, roots = [], [], [], [], []
    for f, t, down, v in trees:
        start = len(feature)
        roots.append(start)
        feature += [int(x) if d else 0 for x, d in zip(f, down)]
        limit += [repr(float(x)) + "D" if d else "double('Infinity')" for x, d in zip(t, down)]
        left += [start + int(d) if d else start + k for k, d in enumerate(down)]
        value += [repr(float(x)) + "D" for x in v]
    lists = {name: f"array({', '.join(map(str, x))})" for name, x in (("f", feature), ("t", limit), ("l", left), ("v", value), ("r", roots))}
    x = f"array({', '.join(f'`{c}`' for c in columns)})"
    step = f"get({lists['l']}, n) + if(get({x}, get({lists['f']}, n)) > get({lists['t']}, n), 1, 0)"
    walk_ = f"aggregate(sequence(1, {depth}), r, (n, i) -> {step})"
    return f"aggregate({lists['r']}, {float(base)!r}D, (total, r) -> total + get({lists['v']}, {walk_}))"
