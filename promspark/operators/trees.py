"""Cross-validated decision trees, grown together.

A level of a tree needs, for every node, feature and bin, the number of rows and the sums of the label and its square
only.  The rows are binned once; one pass a level then makes these sums for the trees of all folds, repeats and settings, and
one last pass scores them on the rows they were not fitted on.  So the number of readings is the depth of the
deepest tree, not folds times settings times depth.  A tree of a smaller depth is the top of a deeper one.

Splits are those of Spark ML's trees: at most ``max_bins`` bins a feature, cut between all values of the training
set where they are few, and into bins of about equal counts otherwise; a feature of more than MAX_VALUES values is
cut at approximate percentiles of all training rows.  A split must lower the variance, or the Gini impurity of labels
0 and 1; the gain is worked out in the order that Spark ML does, as its rounding decides between equal splits.
The first feature and cut win ties.  A null number counts as larger than all others.
Categoricals get one column per label of the training rows and one for nulls and other labels.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .split import folds as add_folds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_VALUES = 5000
BLOCK = 1 << 17  # rows that a task takes at a time
TEST = (-1, -1)


@dataclass
class Tree:
    """A tree over bins: node 0 is the root, the children of node k are child[k] and child[k] + 1, a leaf is its
    own child.  ``n`` and ``s`` are the rows of a node and the sum of their labels."""

    held: tuple[int, int]  # (repeat, fold) left out, TEST for the tree of all training rows
    min_weight: float = 0.0
    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [1 << 30])
    child: list[int] = field(default_factory=lambda: [0])
    level: list[int] = field(default_factory=lambda: [0])
    n: list[float] = field(default_factory=lambda: [0.0])
    s: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row (a column of ``x``) ends in."""
        feature, cut, child = (np.array(a) for a in (self.feature, self.cut, self.child))
        at, row, flat = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1]), x.ravel()
        for _ in range(max(self.level)):
            at = child[at] + (flat[feature[at] * x.shape[1] + row] > cut[at])
        return at

    def ends(self, depth: int, prune: bool = False) -> np.ndarray:
        """The node that stands for each node in the tree of at most ``depth`` levels; ``prune`` joins sibling
        leaves of one predicted class, as Spark ML does."""
        leaf = [c == k or self.level[k] >= depth for k, c in enumerate(self.child)]
        if prune:
            for k in reversed(range(len(leaf))):
                c = self.child[k]
                if not leaf[k] and leaf[c] and leaf[c + 1]:
                    leaf[k] = (2 * self.s[c] > self.n[c]) == (2 * self.s[c + 1] > self.n[c + 1])
        end = np.arange(len(leaf))
        for k, c in enumerate(self.child):  # parents come before their children
            if c != k and (leaf[k] or end[k] != k):
                end[c] = end[c + 1] = end[k]
        return end


def feature_columns(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[Column]:
    """Double columns of all features, the one-hot ones last."""
    out = [F.col(f"`{c}`").cast("double") for c in numeric]
    if categorical:
        found = train.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"l{k}") for k, c in enumerate(categorical)]).first()
        for k, c in enumerate(categorical):
            value = F.col(f"`{c}`").cast("string")
            out += [F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in found[k]]
            known = value.isin(list(found[k])) if found[k] else F.lit(False)
            out.append(F.when(F.coalesce(known, F.lit(False)), 0.0).otherwise(1.0))
    return out


def cuts(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between sorted values: all, or those nearest to equal shares of the rows."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    stride = counts.sum() / (most + 1)
    out, target, upto = [], stride, np.cumsum(counts)
    for k in range(len(middle)):
        if abs(upto[k] - target) < abs(upto[k + 1] - target):
            out.append(middle[k])
            target += stride
    return np.array(out)


def _cut_points(rows: DataFrame, width: int, repeats: int, helds: Sequence[tuple[int, int]], max_bins: int) -> tuple[list[np.ndarray], dict]:
    """(all cuts of each feature, {training set: which of them it uses})."""
    train = rows.where("f0 >= 0")
    xs = [F.col(f"x{j}") for j in range(width)]
    found = train.agg(*[F.approx_count_distinct(x).alias(f"n{j}") for j, x in enumerate(xs)]).first()
    wide = [j for j in range(width) if found[j] > MAX_VALUES]
    shares = [k / max_bins for k in range(1, max_bins)]
    fixed = {}
    if wide:
        got = train.agg(*[F.percentile_approx(xs[j], shares, 10_000).alias(f"q{j}") for j in wide]).first()
        fixed = {j: np.unique(got[f"q{j}"]) for j in wide}
    narrow = [j for j in range(width) if j not in fixed]
    cells = [F.struct(F.lit(j).alias("j"), xs[j].alias("v")) for j in narrow]
    per: dict[int, list] = {j: [] for j in narrow}
    if narrow:
        by = [f"f{r}" for r in range(repeats)]
        tall = train.select(*by, F.explode(F.array(*cells)).alias("c")).where("c.v IS NOT NULL AND NOT isnan(c.v)")
        for r in tall.groupBy(*by, "c.j", "c.v").count().collect():
            per[r["j"]].append((r["v"], r["count"], *(r[f] for f in by)))
    used: dict = {h: {} for h in helds}
    union = []
    for j in range(width):
        if j in fixed:
            union.append(fixed[j])
            for h in helds:
                used[h][j] = np.ones(len(fixed[j]), bool)
            continue
        table = np.array(sorted(per[j]), float).reshape(-1, 2 + repeats)
        each = {}
        for h in helds:
            part = table if h == TEST else table[table[:, 2 + h[0]] != h[1]]
            values, at = np.unique(part[:, 0], return_inverse=True)
            each[h] = cuts(values, np.bincount(at, part[:, 1], len(values)), max_bins - 1)
        union.append(np.unique(np.concatenate(list(each.values()))))
        for h in helds:
            used[h][j] = np.isin(union[j], each[h])
    return union, used


def _binned(points: list[np.ndarray], repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(points)), "<u2")
            for j, p in enumerate(points):
                x[:, j] = np.searchsorted(p, batch.column(repeats + j).to_numpy(zero_copy_only=False).astype(np.float64))  # NaN last
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(points)), batch.num_rows, [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:repeats], batch.column(batch.num_columns - 1), data.cast(pa.binary())],
                                             names=[*(f"f{r}" for r in range(repeats)), "y", "x"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch], repeats: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(folds by repeat, labels, bins by feature) of up to about BLOCK rows."""
    def block(held: list) -> tuple:
        t = pa.Table.from_batches(held)
        parts = []
        for c in t.column(repeats + 1).chunks:  # all values have one length: they lie side by side
            begin = int(np.frombuffer(c.buffers()[1], np.int32, 1, 4 * c.offset)[0])
            parts.append(np.frombuffer(c.buffers()[2], "<u2", len(c) * width, begin).reshape(-1, width))
        return np.array([t.column(r).to_numpy() for r in range(repeats)]), t.column(repeats).to_numpy(), np.ascontiguousarray(np.concatenate(parts).T)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield block(held)
            held, size = [], 0
    if size:
        yield block(held)


def _fitted_on(tree: Tree, fold: np.ndarray) -> np.ndarray:
    return fold[0] >= 0 if tree.held == TEST else (fold[0] >= 0) & (fold[tree.held[0]] != tree.held[1])


def _held_out(tree: Tree, fold: np.ndarray) -> np.ndarray:
    return fold[0] < 0 if tree.held == TEST else (fold[0] >= 0) & (fold[tree.held[0]] == tree.held[1])


def _summed(table: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums over all tasks of the arrays {tree: sums} that ``run`` makes of a task's rows."""
    def first(batches):
        for t, a in run(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([a.astype("<f8").tobytes()], pa.binary())], names=["t", "data"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[t] = sums.get(t, 0) + np.frombuffer(d, "<f8")
        yield from first_of(sums)

    def first_of(sums):
        for t, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["t", "data"])

    kind = "t int, data binary"
    return {r["t"]: np.frombuffer(r["data"], "<f8") for r in table.mapInArrow(first, kind).repartition("t").mapInArrow(total, kind).collect()}


def _gini(n, s):
    a, b = (n - s) / n, s / n
    return 1.0 - a * a - b * b


def _variance(n, s, q):
    return (q - s * s / n) / n


def _gain(impurity, whole: list, left: list, hot: bool):
    """``whole`` and ``left``: rows, sum of labels and, for the variance, of their squares."""
    right = [w - x for w, x in zip(whole, left)]
    if hot:  # two categories: the one with the lower mean is on the left
        swap = left[1] / left[0] > right[1] / right[0]
        left, right = [np.where(swap, r, x) for x, r in zip(left, right)], [np.where(swap, x, r) for x, r in zip(left, right)]
    return impurity(*whole) - left[0] / whole[0] * impurity(*left) - right[0] / whole[0] * impurity(*right)


def _grow(table: DataFrame, trees: Sequence[Tree], points: list[np.ndarray], used: dict, repeats: int, depth: int, gini: bool, numeric: int) -> None:
    widths = [len(p) + 1 for p in points]
    some = [j for j, w in enumerate(widths) if w > 1]
    starts = np.concatenate([[0], np.cumsum([widths[j] for j in some])]).astype(np.int64)
    frontier, moments = [[0] for _ in trees], 2 if gini else 3
    for level in range(depth):
        slots = []
        for tree, nodes in zip(trees, frontier):
            slot = np.full(len(tree.child), -1, np.int64)
            slot[nodes] = np.arange(len(nodes))
            slots.append(slot)

        def sums(batches, trees=tuple(trees), slots=tuple(slots), sizes=tuple(map(len, frontier))) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for fold, y, x in _blocks(batches, repeats, len(widths)):
                for t, tree in enumerate(trees):
                    if not sizes[t]:
                        continue
                    slot = slots[t][tree.nodes(x)]
                    rows = np.flatnonzero((slot >= 0) & _fitted_on(tree, fold))
                    slot, label = slot[rows], y[rows]
                    got = []
                    for j in some:
                        at = slot * widths[j] + x[j][rows]
                        got += [np.bincount(at, w, sizes[t] * widths[j]) for w in (None, label, label * label)[:moments]]
                    got.append(np.zeros(0))
                    if not some:
                        got = [np.bincount(slot, None, sizes[t]), np.bincount(slot, label, sizes[t])]
                    out[t] = out.get(t, 0) + np.concatenate(got)
            return out

        found = _summed(table, sums)
        for t, tree in enumerate(trees):
            nodes, frontier[t] = frontier[t], []
            if not nodes or t not in found:
                continue
            m, data = len(nodes), found[t]
            if not some:
                tree.n, tree.s = [float(data[0])], [float(data[1])]
                continue
            best = np.full(m, 0.0)
            choice = np.full((m, 2), -1)
            left = np.zeros((m, 2))
            for i, j in enumerate(some):
                sums_ = data[moments * m * starts[i]:moments * m * starts[i + 1]].reshape(moments, m, widths[j]).cumsum(2)
                whole, upto = [a[:, -1:] for a in sums_], [a[:, :-1] for a in sums_]
                if not level and not i:
                    tree.n, tree.s = [float(whole[0][0, 0])], [float(whole[1][0, 0])]
                nl, sl = upto[:2]
                least = max(1.0, tree.min_weight * tree.n[0])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = _gain(_gini if gini else _variance, whole, upto, j >= numeric)
                    gain = np.where((nl >= least) & (whole[0] - nl >= least) & used[tree.held][j], gain, -1)
                k = gain.argmax(1)
                g = gain[np.arange(m), k]
                better = g > best
                best = np.where(better, g, best)
                choice[better] = np.column_stack([np.full(m, j), k])[better]
                left[better] = np.column_stack([nl[np.arange(m), k], sl[np.arange(m), k]])[better]
            for q, node in enumerate(nodes):
                if choice[q, 0] >= 0:
                    tree.feature[node], tree.cut[node], tree.child[node] = int(choice[q, 0]), int(choice[q, 1]), len(tree.child)
                    for n, s in (left[q], (tree.n[node] - left[q, 0], tree.s[node] - left[q, 1])):
                        frontier[t].append(len(tree.child))
                        tree.child.append(len(tree.child))
                        tree.feature.append(0)
                        tree.cut.append(1 << 30)
                        tree.level.append(level + 1)
                        tree.n.append(float(n))
                        tree.s.append(float(s))
        if not any(frontier):
            break


@dataclass
class Grown:
    """The trees in the order of ``helds`` x ``min_weights``, and for each its scores on held-out rows: an array of
    (rows, sum of labels, sum of their squares, sum of absolute errors) per node in which rows end."""

    trees: list[Tree]
    scores: list[np.ndarray]
    table: DataFrame
    repeats: int
    width: int

    def of(self, held: tuple[int, int], min_weight: float = 0.0) -> int:
        return next(i for i, t in enumerate(self.trees) if t.held == held and t.min_weight == min_weight)

    def test_scores(self, i: int, value: Sequence[float]) -> DataFrame:
        """(label, score) of the test rows, scored with the value of the node of tree ``i`` that they end in."""
        tree, value, repeats, width = self.trees[i], np.array(value), self.repeats, self.width

        def run(batches):
            for fold, y, x in _blocks(batches, repeats, width):
                rows = np.flatnonzero(fold[0] < 0)
                yield pa.RecordBatch.from_arrays([pa.array(y[rows]), pa.array(value[tree.nodes(x[:, rows])])], names=["label", "score"])
        return self.table.where("f0 < 0").mapInArrow(run, "label double, score double")


def grow(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], depth: int, min_weights: Sequence[float] = (0.0,),
         k: int = 5, repeats: int = 1, key: str = "record_id", max_bins: int = 32, cv: bool = True, gini: bool = False) -> Grown:
    """Trees of every training set (each fold of each repeat left out, and all training rows; ``split`` is ``test``
    for the others) and least share of a node's rows."""
    xs = feature_columns(df.where(F.col("split") != "test"), numeric, categorical)
    for r in range(repeats):
        df = add_folds(df, k, key, repeat=r, col=f"__f{r}")
    test = F.col("split") == "test"
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(*[F.when(test, -1).otherwise(F.col(f"__f{r}")).alias(f"f{r}") for r in range(repeats)],
                     *[x.alias(f"x{i}") for i, x in enumerate(xs)], F.col(f"`{label}`").cast("double").alias("y"))
    helds = [*((r, f) for r in range(repeats) for f in range(k) if cv), TEST]
    points, used = _cut_points(rows, len(xs), repeats, helds, max_bins)
    kind = ", ".join([*(f"f{r} int" for r in range(repeats)), "y double", "x binary"])
    table = written_table(rows.mapInArrow(_binned(points, repeats), kind))
    trees = [Tree(h, w) for h in helds for w in min_weights]
    _grow(table, trees, points, used, repeats, depth, gini, len(numeric))

    width = len(xs)

    def scores(batches, trees=tuple(trees)) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for fold, y, x in _blocks(batches, repeats, width):
            for t, tree in enumerate(trees):
                part = np.flatnonzero(_held_out(tree, fold))
                at, v = tree.nodes(x[:, part]), y[part]
                value = np.array(tree.s) / np.maximum(tree.n, 1e-300)
                e = np.abs(v - value[at])
                out[t] = out.get(t, 0) + np.concatenate([np.bincount(at, w, len(value)) for w in (None, v, v * v, e)])
        return out

    found = _summed(table, scores)
    return Grown(trees, [found.get(t, np.zeros(4 * len(tree.child))).reshape(4, -1) for t, tree in enumerate(trees)], table, repeats, width)


def regression_scores(got: Grown, i: int) -> tuple | None:
    """(n, mae, rmse, r2) of tree ``i`` on its held-out rows."""
    tree, (n, s, q, e) = got.trees[i], got.scores[i]
    value, count = np.array(tree.s) / np.maximum(tree.n, 1e-300), n.sum()
    if not count:
        return None
    sse = float((q - 2 * value * s + value * value * n).sum())
    sst = float(q.sum() - s.sum() ** 2 / count)
    return int(count), float(e.sum() / count), (max(sse, 0.0) / count) ** 0.5, 1 - sse / sst if sst else None


def auc(value: Sequence[float], pos: np.ndarray, neg: np.ndarray) -> float:
    """ROC AUC of groups of rows with one score each, ties counting half."""
    _, at = np.unique(value, return_inverse=True)
    p, n = np.bincount(at, pos), np.bincount(at, neg)
    return float((p * (n.cumsum() - n / 2)).sum() / (p.sum() * n.sum())) if p.sum() * n.sum() else 0.0
