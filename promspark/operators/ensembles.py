"""Forests and boosted trees grown together.

The rows are binned once, as for the single trees of ``trees``.  What a tree needs are, for its open nodes, the rows
and the sum of the labels by feature and bin; neighbouring features of few bins are counted together and taken apart
afterwards, and of two sibling nodes the smaller is counted, the other is what is left of their parent.

* A table of at most HELD bytes goes whole to several tasks, each of which grows some of the trees.
* A forest of a larger table takes a reading a level: the tasks that add the sums up also choose the splits, so that only
  splits come to the driver.  Sums of more than HELD bytes are made for some of the trees at a time.
* Boosted models of a larger table take a reading a level too, all models together.  Their rows are kept in blocks
  beside the scores of each model, so a reading moves a few large cells; every REPLAY rounds the scores are made anew.

Splits are those of Spark ML's trees: ``trees.cuts``, the largest fall of the variance (of labels 0 and 1 that is half
the Gini impurity), first feature and cut on ties.  Forests draw a Poisson(1) weight per row and tree and look at all
features or at a random square root of them per node; boosting draws a share of the rows per round, fits the first tree to
the labels (-1 and 1 for classes) and each next one to the negative gradient of the squared or logistic loss, as Spark ML does.
Draws are hashes of seed, row and node, so the result does not depend on which task reads a row.
"""

from __future__ import annotations

import functools
import math
import pickle
import sys
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import task_slots, written_table
from .split import folds as add_folds
from .trees import BLOCK, TEST, _binned, _cut_points, feature_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 27
REPLAY = 4  # rounds of boosting between two makings of the scores
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
LEAF = np.iinfo(np.int32).max
CELLS = 32  # of features that are counted together
UNIT = 2.0 ** 28


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(numbers: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each whole number, drawn by a hash."""
    start = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (_mix(_mix(numbers.astype(np.uint64) + start) ^ start) >> np.uint64(11)) * 2.0 ** -53


def _poisson(row: np.ndarray, seed: int) -> np.ndarray:
    drawn, out = uniform(row, seed), np.zeros(len(row), np.int8)
    for p in POISSON:
        above = drawn > p
        if not above.any():
            break
        out += above
    return out


@dataclass
class Grown:
    """A tree over bins: the children of node k are child[k] and child[k] + 1, a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    n: np.ndarray
    s: np.ndarray

    @staticmethod
    def root() -> "Grown":
        return Grown(*(np.array([v], np.int32) for v in (0, LEAF, 0)), np.zeros(1), np.zeros(1))

    def ends(self, x: np.ndarray, levels: int, rows: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The node in which each of the rows (columns of ``x``) is ``levels`` below ``at``, the root if None."""
        out = np.zeros(len(rows), np.intp) if at is None else at
        if len(self.child) == 1:
            return out
        most = np.iinfo(x.dtype).max
        first, cut, child, flat = self.feature.astype(np.intp) * x.shape[1], np.minimum(self.cut, most).astype(x.dtype), self.child.astype(np.intp), x.reshape(-1)
        parts = []
        for k in range(0, len(rows), 1 << 15):  # as much as caches hold
            here, row = out[k:k + (1 << 15)], rows[k:k + (1 << 15)]
            for _ in range(levels):
                here = child.take(here) + (flat.take(first.take(here) + row) > cut.take(here))
            parts.append(here)
        return np.concatenate(parts) if parts else out

    @staticmethod
    def packed(trees: Sequence["Grown"]) -> bytes:
        return pickle.dumps([(t.feature, t.cut, t.child, t.n, t.s) for t in trees])

    @staticmethod
    def unpacked(data: bytes) -> list["Grown"]:
        return [Grown(*a) for a in pickle.loads(data)]

    def value(self) -> np.ndarray:
        return self.s / np.maximum(self.n, 1e-300)

    def split(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Splits nodes by (feature, cut, rows and labels on the left, of the node); the new nodes."""
        if not nodes[0]:
            self.n[0], self.s[0] = found[0, 4:]
        took = found[:, 0] >= 0
        nodes, found = nodes[took], found[took]
        left = len(self.child) + 2 * np.arange(len(nodes), dtype=np.int32)
        self.feature[nodes], self.cut[nodes], self.child[nodes] = found[:, 0], found[:, 1], left
        new = np.arange(len(self.child), len(self.child) + 2 * len(nodes), dtype=np.int32)
        self.feature, self.cut = np.append(self.feature, np.zeros(len(new), np.int32)), np.append(self.cut, np.full(len(new), LEAF, np.int32))
        self.child = np.append(self.child, new)
        n, s = (np.stack([found[:, k], found[:, k + 2] - found[:, k]], axis=1).reshape(-1) for k in (2, 3))
        self.n, self.s = np.append(self.n, n), np.append(self.s, s)
        return new


class Bins:
    """Which features are counted together, and where the bins of a feature stand in the sums of a node."""

    def __init__(self, widths: Sequence[int]):
        self.widths, self.most, packs, size = list(widths), max(widths), [], CELLS + 1
        for j, w in enumerate(widths):
            if w > 1:
                if size * w > CELLS:
                    packs.append([])
                    size = 1
                packs[-1].append(j)
                size *= w
        self.packs = packs or [[0]]
        order = [j for p in self.packs for j in p]
        start = dict(zip(order, np.cumsum([0, *(widths[j] for j in order)])))
        self.cells = sum(widths[j] for j in order)
        self.spread = []  # sums by the bins of all features of a pack -> by those of each feature
        for p in self.packs:
            digits = np.indices([widths[j] for j in p]).reshape(len(p), -1)
            self.spread.append(np.concatenate([np.eye(widths[j])[d] for j, d in zip(p, digits)], axis=1))
        self.digits = {j: (p, d) for p, pack in enumerate(self.packs) for j, d in zip(pack, np.indices([widths[j] for j in pack]).reshape(len(pack), -1))}
        self.kind = np.uint8 if self.most <= 256 else np.uint16
        self.groups = []  # features of one width, and their columns
        for w in sorted({widths[j] for j in order}, key=[widths[j] for j in order].index):
            js = np.array([j for j in order if widths[j] == w])
            self.groups.append((js, np.array([start[j] for j in js])[:, None] + np.arange(w)))

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for p in self.packs:
            code = x[p[0]]
            for j in p[1:]:
                code = code * x.dtype.type(self.widths[j]) + x[j]
            out.append(code)
        return out

    def features(self, codes: np.ndarray, trees: Sequence["Grown"]) -> np.ndarray:
        """The bins of the features that the trees look at; others are left unset."""
        x = np.empty((len(self.widths), codes.shape[1]), self.kind)
        for j in {int(j) for tree in trees for j in np.unique(tree.feature)} & self.digits.keys():
            p, digits = self.digits[j]
            digits.astype(self.kind).take(codes[p], out=x[j])
        return x


@dataclass
class Block:
    """Rows that a task takes at a time; ``x`` has a row per feature, ``held`` says in which folds a row is left out."""

    row: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    x: np.ndarray
    codes: list[np.ndarray]


def _rows(batches: Iterator[pa.RecordBatch], bins: Bins, counted: bool = True) -> Iterator[Block]:
    """Blocks of up to about BLOCK rows."""
    width = len(bins.widths)

    def block(held: list) -> Block:
        t = pa.Table.from_batches(held)
        parts = [np.frombuffer(b.buffers()[2], "<u2", len(b) * width, int(np.frombuffer(b.buffers()[1], np.int32, 1, 4 * b.offset)[0])) for b in t.column("x").chunks]
        x = np.ascontiguousarray(np.concatenate(parts).reshape(t.num_rows, width).astype(bins.kind).T)
        return Block(*(t.column(c).to_numpy() for c in ("row", "y", "w", "held")), x, bins.codes(x) if counted else [])

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


@dataclass
class Binned:
    """Training and test rows, and for each training set the cuts that it uses."""

    train: DataFrame
    test: DataFrame
    bins: Bins
    used: dict
    k: int
    rows: int

    def out(self, held: tuple[int, int]) -> Callable[[np.ndarray], np.ndarray] | None:
        """Says which of the rows a training set leaves out."""
        k = self.k
        return None if held == TEST else lambda numbers: numbers // k ** held[0] % k == held[1]

    def held_out(self, held: tuple[int, int]) -> DataFrame:
        return self.test if held == TEST else self.train.where(F.expr(f"held div {self.k ** held[0]} % {self.k} = {held[1]}"))

    def small(self) -> bool:
        return self.rows * (2 * len(self.bins.widths) + 32) <= HELD


def binned(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], weight: Column | None = None, max_bins: int = 32,
           k: int = 1, repeats: int = 0, key: str = "record_id") -> Binned:
    """``split`` is ``test`` for the test rows; with repeats, also the training sets with each fold of each repeat left out."""
    xs = feature_columns(df.where(F.col("split") != "test"), numeric, categorical)
    for r in range(repeats):
        df = add_folds(df, k, key, repeat=r, col=f"__f{r}")
    number = sum((F.coalesce(F.col(f"__f{r}"), F.lit(0)) * k ** r for r in range(repeats)), F.lit(0))
    test = F.when(F.col("split") == "test", -1).otherwise(0)
    folds = [F.when(F.col("split") == "test", -1).otherwise(F.col(f"__f{r}")).alias(f"f{r}") for r in range(repeats)] or [test.alias("f0")]
    at = len(folds)
    extra = [F.monotonically_increasing_id(), (F.lit(1.0) if weight is None else weight).cast("double"), number.cast("int")]
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(*folds, *[c.alias(f"f{at + i}") for i, c in enumerate(extra)],
                                                            *[x.alias(f"x{i}") for i, x in enumerate(xs)], F.col(f"`{label}`").cast("double").alias("y"))
    helds = [*((r, f) for r in range(repeats) for f in range(k)), TEST]
    points, used = _cut_points(rows, len(xs), at, helds, max_bins)
    kinds = ["int"] * at + ["bigint", "double", "int"]
    table = written_table(rows.mapInArrow(_binned(points, at + 3), ", ".join([*(f"f{i} {t}" for i, t in enumerate(kinds)), "y double", "x binary"])))
    train, test = (table.where(c).select(F.col(f"f{at}").alias("row"), "y", F.col(f"f{at + 1}").alias("w"), F.col(f"f{at + 2}").alias("held"), "x") for c in ("f0 >= 0", "f0 < 0"))
    return Binned(train, test, Bins([len(p) + 1 for p in points]), used, k, train.count())


def _chosen(nodes: np.ndarray, seed: int, width: int, some: int) -> np.ndarray:
    """``some`` random features of each node, in order."""
    draw = uniform(nodes[:, None].astype(np.int64) * width + np.arange(width), seed ^ 0x5DEECE66D)
    return np.sort(np.argsort(draw, axis=1)[:, :some], axis=1)


def _sums(block: Block, rows: np.ndarray, slot: np.ndarray, m: int, n: np.ndarray | None, s: np.ndarray, bins: Bins, features: np.ndarray | None) -> np.ndarray:
    """Rows and sums of labels by node, feature and bin: of all features, or of the chosen ones of each node.
    ``n`` None: all rows weigh 1.  Small whole numbers are added up both at once, which is exact."""
    both = None
    if n is not None and np.abs(s).sum() < UNIT / 2 and n.sum() < UNIT / 16 and np.array_equal(n, np.rint(n)) and np.array_equal(s, np.rint(s)):
        both = n * UNIT + s

    def added(at, size, spread=None):
        def one(v):
            a = np.bincount(at, v, size).astype(np.float64, copy=False).reshape(m, -1)
            return a if spread is None else a @ spread
        if both is None:
            return one(n), one(s)
        a = one(both)
        whole = np.floor(a / UNIT + 0.5)
        return whole, a - whole * UNIT

    if features is None:
        out, place = np.empty((2, m, bins.cells)), 0
        for code, spread in zip(block.codes, bins.spread):
            at = slot * spread.shape[0]
            at += code.take(rows)
            out[0, :, place:place + spread.shape[1]], out[1, :, place:place + spread.shape[1]] = added(at, m * spread.shape[0], spread)
            place += spread.shape[1]
        return out
    out, flat, wide = np.empty((2, m, features.shape[1], bins.most)), block.x.reshape(-1), features.astype(np.intp) * block.x.shape[1]
    for c in range(features.shape[1]):
        at = slot * bins.most
        at += flat.take(wide[:, c].take(slot) + rows)
        out[0, :, c], out[1, :, c] = added(at, m * bins.most)
    return out.reshape(2, m, -1)


def _splits(data: np.ndarray, bins: Bins, features: np.ndarray | None, used: dict) -> np.ndarray:
    """(feature, cut, rows and labels on the left, of the node) of the best split per node; feature -1: none."""
    m = data.shape[1]
    best, out, at = None, np.full((m, 6), -1.0), np.arange(m)
    for js, columns in bins.groups if features is None else [(features, None)]:
        part = data[:, :, columns] if features is None else data.reshape(2, m, -1, bins.most)
        n, s = part.cumsum(3)
        whole_n, whole_s = n[..., -1:], s[..., -1:]
        base = whole_s ** 2 / np.maximum(whole_n, 1e-300)
        if best is None:
            out[:, 4], out[:, 5], best = whole_n[:, 0, 0], whole_s[:, 0, 0], 1e-12 * base[:, 0, 0] + 1e-300
        n, s = n[..., :-1], s[..., :-1]
        if not n.shape[-1]:
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s ** 2 / n + (whole_s - s) ** 2 / (whole_n - n) - base
        fits = (n > 0) & (whole_n - n > 0)
        if features is None:
            fits &= np.array([used[j] for j in js])
        else:
            fits &= np.array([np.resize(np.append(u, np.zeros(bins.most, bool)), bins.most - 1) for u in (used[j] for j in range(len(bins.widths)))])[features]
        gain = np.where(fits, gain, -1).reshape(m, -1)
        k = gain.argmax(1)
        g, (c, cut) = gain[at, k], divmod(k, n.shape[-1])
        j = js[c] if features is None else features[at, c]
        better = (g > best) | (g == best) & (j < out[:, 0])
        best = np.where(better, g, best)
        out[better, :4] = np.column_stack([j, cut, n[at, c, cut], s[at, c, cut]])[better]
    return out


def _open(tree: Grown, new: np.ndarray, classes: bool) -> np.ndarray:
    n, s = tree.n[new], tree.s[new]
    return (s > 0) & (s < n) if classes else n > 1


@dataclass
class Share:
    """Rows of a block that a tree is grown on: ``n`` None if all weigh 1, and the nodes that they are in."""

    block: Block
    rows: np.ndarray
    n: np.ndarray | None
    s: np.ndarray
    at: np.ndarray
    drawn: np.ndarray | None = None


def _growth(tree: Grown, bins: Bins, used: dict, depth: int, seed: int = 0, some: int = 0, classes: bool = False, whole: bool = True) -> Generator:
    """Grows a tree: yields (level, nodes, their features) of which it is sent the sums.  With ``whole`` weights the
    sums of a node are also those of its parent without its sibling's."""
    nodes, data, took, new, open_ = np.zeros(1, np.intp), None, None, None, None
    for level in range(depth):
        if not len(nodes):
            return
        features = _chosen(nodes, seed, len(bins.widths), some) if some else None
        if some or not level or not whole:
            data = yield level, nodes, features
        else:
            pairs, alive = new.reshape(-1, 2), open_.reshape(-1, 2)
            live = alive.any(1)
            pairs, alive, parent = pairs[live], alive[live], data[:, took][:, live]
            each = np.arange(len(pairs))
            fewer = (tree.n[pairs[:, 1]] < tree.n[pairs[:, 0]]).astype(np.intp)
            part = yield level, pairs[each, fewer], None
            data = np.empty((2, len(pairs), 2, bins.cells))
            data[:, each, fewer], data[:, each, 1 - fewer] = part, parent - part
            data = data.reshape(2, -1, bins.cells)[:, alive.reshape(-1)]
        found = _splits(data, bins, features, used)
        took = found[:, 0] >= 0
        new = tree.split(nodes, found)
        open_ = _open(tree, new, classes)
        nodes = new[open_].astype(np.intp)


def _share_sums(tree: Grown, one: Share, nodes: np.ndarray, features: np.ndarray | None, bins: Bins) -> np.ndarray:
    slots = np.full(len(tree.child), -1, np.intp)
    slots[nodes] = np.arange(len(nodes))
    slot = slots.take(one.at)
    took = np.flatnonzero(slot >= 0 if one.drawn is None else (slot >= 0) & one.drawn)
    return _sums(one.block, one.rows.take(took), slot.take(took), len(nodes), None if one.n is None else one.n.take(took), one.s.take(took), bins, features)


def _grow_here(tree: Grown, shares: list[Share], bins: Bins, *how) -> None:
    """Grows a tree on rows that are all at hand."""
    growth = _growth(tree, bins, *how)
    asked = next(growth, None)
    while asked:
        level, nodes, features = asked
        out = None
        for one in shares:
            if level:
                one.at = tree.ends(one.block.x, 1, one.rows, one.at)
            part = _share_sums(tree, one, nodes, features, bins)
            out = part if out is None else np.add(out, part, out=out)
        try:
            asked = growth.send(out)
        except StopIteration:
            return


def _copies(table: DataFrame, parts: int) -> DataFrame:
    """The whole table in each of ``parts`` partitions."""
    return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, "part").drop("part")


def _grow(data: Binned, trees: Sequence[Grown], seeds: Sequence[int], depth: int, some: int, classes: bool, held: tuple[int, int], whole: bool) -> list[Grown]:
    """The trees of a forest by readings of the table, a level each."""
    frontier, bins, used = [np.zeros(1, np.int32) for _ in trees], data.bins, data.used[held]
    left_out, cells = data.out(held), 2 * (some * bins.most if some else bins.cells)
    for level in range(depth):
        todo = [t for t, nodes in enumerate(frontier) if len(nodes)]
        while todo:
            group, size = [], 0
            while todo and (not group or size + 8 * cells * len(frontier[todo[0]]) <= HELD):
                size += 8 * cells * len(frontier[todo[0]])
                group.append(todo.pop(0))
            of = {t: (trees[t], frontier[t], _chosen(frontier[t], seeds[t], len(bins.widths), some) if some else None) for t in group}

            def first(batches, of=of, level=level):
                sums: dict[int, np.ndarray] = {}
                for block in _rows(batches, bins):
                    for t, (tree, nodes, features) in of.items():
                        one = _drawn(block, seeds[t], left_out, whole)
                        one.at = tree.ends(block.x, level, one.rows)
                        part = _share_sums(tree, one, nodes, features, bins)
                        sums[t] = np.add(sums[t], part, out=sums[t]) if t in sums else part
                for t, a in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([a.astype("<f8").tobytes()], pa.binary())], names=["t", "data"])

            def total(batches, of=of):
                sums: dict[int, np.ndarray] = {}
                for batch in batches:
                    for t, d in zip(batch.column(0).to_pylist(), batch.column(1)):
                        part = np.frombuffer(d.as_buffer(), "<f8")
                        sums[t] = sums[t] + part if t in sums else part
                for t, a in sums.items():
                    found = _splits(a.reshape(2, len(of[t][1]), -1), bins, of[t][2], used)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["t", "data"])

            kind = "t int, data binary"
            found = {r["t"]: np.frombuffer(r["data"], "<f8").reshape(-1, 6) for r in data.train.mapInArrow(first, kind).repartition("t").mapInArrow(total, kind).collect()}
            for t in group:
                new = trees[t].split(frontier[t], found[t]) if t in found else frontier[t][:0]
                frontier[t] = new[_open(trees[t], new, classes)]
    return list(trees)


def _drawn(block: Block, seed: int, left_out: Callable | None, whole: bool) -> Share:
    """The rows of a block in a bootstrap sample; ``whole``: all rows weigh 1."""
    n = _poisson(block.row, seed) * (1.0 if whole else block.w)
    rows = np.flatnonzero(n if left_out is None else (n != 0) & ~left_out(block.held))
    n = n.take(rows)
    return Share(block, rows, n, n * block.y.take(rows), np.zeros(len(rows), np.intp))


def forest_of(data: Binned, trees: int, depth: int, seed: int, classes: bool = False, held: tuple[int, int] = TEST, whole: bool = True) -> DataFrame:
    """(label, score, prediction) of the rows that a training set leaves out; ``whole``: the table's weights are not used."""
    bins, used, left_out = data.bins, data.used[held], data.out(held)
    seeds, some = [seed * 1_000_003 + t for t in range(trees)], math.ceil(math.sqrt(len(bins.widths))) if classes else 0
    if data.small():
        parts = max(1, min(trees, task_slots(data.train.sparkSession)))

        def grow(batches):
            blocks = list(_rows(batches, bins))
            for t in range(TaskContext.get().partitionId(), trees if blocks else 0, parts):
                tree = Grown.root()
                _grow_here(tree, [_drawn(b, seeds[t], left_out, whole) for b in blocks], bins, used, depth, seeds[t], some, classes, whole)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([Grown.packed([tree])], pa.binary())], names=["t", "tree"])
        found = {r["t"]: Grown.unpacked(r["tree"])[0] for r in _copies(data.train, parts).mapInArrow(grow, "t int, tree binary").collect()}
        grown = [found.get(t, Grown.root()) for t in range(trees)]
    else:
        grown = _grow(data, [Grown.root() for _ in range(trees)], seeds, depth, some, classes, held, whole)

    def score(batches):
        for block in _rows(batches, bins, counted=False):
            rows = np.arange(len(block.y))
            mean = sum(tree.value()[tree.ends(block.x, depth, rows)] for tree in grown) / len(grown)
            yield pa.RecordBatch.from_arrays([pa.array(block.y), pa.array(mean), pa.array((mean > 0.5).astype(np.float64) if classes else mean)], names=["label", "score", "prediction"])
    return data.held_out(held).mapInArrow(score, "label double, score double, prediction double")


def forest(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], trees: int, depth: int, seed: int, classes: bool = False, weight: Column | None = None) -> DataFrame:
    """(label, score, prediction) of the test rows by a random forest of the training rows: the mean of its trees'
    means or, of classes 0 and 1, shares of class 1; those look at a square root of the features per node."""
    return forest_of(binned(df, label, numeric, categorical, weight), trees, depth, seed, classes, whole=weight is None)


@dataclass
class Boosting:
    """What the rounds of a set of models have in common; a model is (seed, cuts that it uses, rows that it leaves out)."""

    bins: Bins
    depth: int
    step: float
    share: float
    classes: bool
    models: list[tuple[int, dict, Callable | None]]

    def scored(self, x: np.ndarray, trees: Sequence[Grown], begin: int = 0, scores: np.ndarray | float = 0.0) -> np.ndarray:
        """Scores after the trees of round ``begin`` and later."""
        rows = np.arange(x.shape[1])
        for k, tree in enumerate(trees, begin):
            scores = scores + (tree.value() * (self.step if k else 1.0)).take(tree.ends(x, self.depth, rows))
        return scores

    def share_of(self, block: Block, t: int, m: int, scores: np.ndarray | float) -> Share:
        """What the tree of round ``m`` of model ``t`` is fitted to."""
        seed, _, left_out = self.models[t]
        y = 2 * block.y - 1 if self.classes else block.y
        label = y if not m else 4 * y / (1 + np.exp(2 * y * scores)) if self.classes else 2 * (y - scores)
        drawn = None if self.share >= 1 else uniform(block.row, seed * 1_000_003 + m) < self.share
        if left_out is not None:
            drawn = ~left_out(block.held) if drawn is None else drawn & ~left_out(block.held)
        rows = np.arange(len(y))
        return Share(block, rows, None, label, np.zeros(len(rows), np.intp), drawn)

    def fit_here(self, blocks: list[Block], t: int, rounds: int) -> list[Grown]:
        """All rounds of a model, on rows that are all at hand."""
        scores, done = [0.0] * len(blocks), []
        for m in range(rounds):
            tree = Grown.root()
            _grow_here(tree, [self.share_of(b, t, m, f) for b, f in zip(blocks, scores)], self.bins, self.models[t][1], self.depth)
            scores = [self.scored(b.x, [tree], m, f) for b, f in zip(blocks, scores)]
            done.append(tree)
        return done

    def fit(self, table: DataFrame, rounds: int, parts: int) -> list[list[Grown]]:
        """All rounds of all models, a job a level; the rows stay in blocks, with the scores of each model
        after the last REPLAY-th round."""
        bins, many = self.bins, range(len(self.models))

        folds = any(left_out for _, _, left_out in self.models)
        kinds = [("<i8", 1), ("<f8", 1), ("<i4", int(folds)), ("<f8", len(many)), (np.dtype(bins.kind).str, len(bins.packs))]
        size = sum(np.dtype(kind).itemsize * n for kind, n in kinds)

        def packed(*arrays):
            return b"".join(np.ascontiguousarray(a, kind).tobytes() for a, (kind, n) in zip(arrays, kinds) if n)

        def unpacked(data):
            place, n, out = 0, len(data) // size, []
            for kind, many in kinds:
                out.append(np.frombuffer(data, kind, many * n, place).reshape(many, n))
                place += out[-1].nbytes
            return out

        def pack(batches):
            for b in _rows(batches, bins):
                data = packed(b.row, b.y, b.held, np.zeros((len(many), len(b.y))), np.stack(b.codes))
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["block"])

        blocks = table.repartitionById(parts, (F.col("row") % parts).cast("int")).mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        done: list[list[Grown]] = [[] for _ in many]
        written = 0
        for m in range(rounds):
            trees, recent = [Grown.root() for _ in many], [d[written:] for d in done]
            growths = [_growth(tree, bins, model[1], self.depth) for tree, model in zip(trees, self.models)]
            asked = {t: next(g, None) for t, g in enumerate(growths)}
            while asked := {t: a for t, a in asked.items() if a is not None}:

                def sums(part, m=m, asked=asked, trees=trees, recent=recent, begin=written):
                    out: dict[int, np.ndarray] = {}
                    for row, y, held, scores, codes in map(unpacked, part):
                        x = bins.features(codes, [tree for t in asked for tree in [trees[t], *recent[t]]])
                        block = Block(row[0], y[0], y[0], held[0] if folds else row[0], x, list(codes))
                        for t, (level, nodes, _) in asked.items():
                            one = self.share_of(block, t, m, self.scored(block.x, recent[t], begin, scores[t]))
                            one.at = trees[t].ends(block.x, level, one.rows, one.at)
                            got = _share_sums(trees[t], one, nodes, None, bins)
                            out[t] = np.add(out[t], got, out=out[t]) if t in out else got
                    return [out] if out else []

                def both(a, b):
                    return {t: a[t] + b[t] for t in a}
                part = blocks.mapPartitions(sums)
                total = part.treeReduce(both) if parts > 64 else functools.reduce(both, part.collect())
                for t in list(asked):
                    try:
                        asked[t] = growths[t].send(total[t])
                    except StopIteration:
                        asked[t] = None
            for d, tree in zip(done, trees):
                d.append(tree)
            if m + 1 - written == REPLAY and m + 1 < rounds:

                def advanced(data, begin=written, recent=[d[written:] for d in done]):
                    row, y, held, scores, codes = unpacked(data)
                    x = bins.features(codes, [tree for trees in recent for tree in trees])
                    return packed(row, y, held, np.stack([self.scored(x, recent[t], begin, scores[t]) for t in many]), codes)
                last, blocks = blocks, blocks.map(advanced).persist(StorageLevel.MEMORY_AND_DISK)
                blocks.count()
                last.unpersist()
                written = m + 1
        blocks.unpersist()
        return done


def boosted_of(data: Binned, rounds: int, depth: int, step: float, models: Sequence[tuple[int, tuple[int, int]]], share: float = 1.0, classes: bool = False) -> list[DataFrame]:
    """(label, score, prediction) of the rows that its training set leaves out, for each model (seed, training set)."""
    slots = task_slots(data.train.sparkSession)
    boosting = Boosting(data.bins, depth, step, share, classes, [(seed, data.used[held], data.out(held)) for seed, held in models])
    if not data.rows:
        done = [[Grown.root()] for _ in models]
    elif data.small() and (data.rows <= BLOCK or len(models) >= slots):
        parts = min(len(models), slots)

        def fit(batches):
            blocks = list(_rows(batches, boosting.bins))
            for t in range(TaskContext.get().partitionId(), len(models), parts):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([Grown.packed(boosting.fit_here(blocks, t, rounds))], pa.binary())], names=["t", "trees"])
        found = {r["t"]: Grown.unpacked(r["trees"]) for r in _copies(data.train, parts).mapInArrow(fit, "t int, trees binary").collect()}
        done = [found[t] for t in range(len(models))]
    else:
        done = boosting.fit(data.train, rounds, max(1, min(data.rows // (BLOCK // 2), max(slots, data.rows >> 20))))

    def of_model(t):
        def score(batches, trees=done[t]):
            for block in _rows(batches, boosting.bins, counted=False):
                f = boosting.scored(block.x, trees)
                both = (1 / (1 + np.exp(-2 * f)), (f > 0).astype(np.float64)) if classes else (f, f)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (block.y, *both)], names=["label", "score", "prediction"])
        return data.held_out(models[t][1]).mapInArrow(score, "label double, score double, prediction double")
    return [of_model(t) for t in range(len(models))]


def boosted(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], rounds: int, depth: int, step: float, seeds: Sequence[int], share: float = 1.0, classes: bool = False) -> list[DataFrame]:
    """(label, score, prediction) of the test rows by gradient-boosted trees of the training rows, for each seed;
    the score is the probability of class 1 for classes 0 and 1."""
    return boosted_of(binned(df, label, numeric, categorical), rounds, depth, step, [(s, TEST) for s in seeds], share, classes)
