"""Tree classifiers fitted on counts.

A tree that splits on at most ``BINS`` bins of a feature (Spark ML's default) sees of a row nothing but its bins and its class. Rows of equal
bins are one cell; one aggregate counts all rows by cell and class, and trees grow on these counts. What is drawn by row keeps its law: the
bootstrap draws of a cell's n rows together are one Poisson draw of mean n, and n rows that each stay with probability p are one binomial draw.

A fitted model is constant inside a cell, so it is kept as the class of every cell of the grid, of those without training rows as well.
The trees of a forest, and the classes of one-vs-rest boosting, grow in tasks of their own, which get the counts by broadcast. Both are
bounded by the grid; where that is over ``GRID`` cells, :func:`count_cells` gives None.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import bucket_counts
from ..session import stored
from .boosting import SEED, Tree

BINS = 32
#: Cells of a grid, and cells times classes, that a task may hold; features of a row, as trees see them.
GRID, SCORES, WIDE = 4_000_000, 16_000_000, 255
#: Error of the sketch that places cuts, as a share of the rows: 1 / SKETCH.
SKETCH = 1000
CELL = "__cell"

#: Settings that trees on counts know, by kind of classifier.
SETTINGS: Mapping[str, frozenset[str]] = {
    "arvore_decisao": frozenset({"maxDepth", "minInstancesPerNode"}),
    "random_forest": frozenset({"numTrees", "maxDepth", "minInstancesPerNode"}),
    "boosting": frozenset({"maxIter", "stepSize", "maxDepth", "subsamplingRate", "minInstancesPerNode"}),
}


@dataclass(frozen=True)
class Axis:
    """One feature of the grid. A number's bin i holds what is over ``cuts[i - 1]`` up to ``cuts[i]``, and the last one null and NaN as well; a
    category's bin is the place of its value, or one more for any other value."""

    feature: str
    cuts: tuple[float, ...] | None = None
    values: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return len(self.values if self.cuts is None else self.cuts) + 1

    @property
    def width(self) -> int:
        """Columns that trees see: the bin of a number, a flag for each value of a category."""
        return len(self.values) if self.cuts is None else 1

    def bin_sql(self) -> str:
        if self.cuts is None:
            found = "".join(f" WHEN {_literal(v)} THEN {i}" for i, v in enumerate(self.values))
            return f"CASE `{self.feature}`{found} ELSE {len(self.values)} END" if found else "0"

        def between(low: int, high: int) -> str:
            if low == high:
                return str(low)
            at = (low + high) // 2
            return f"CASE WHEN `{self.feature}__scaled` <= {self.cuts[at]!r}D THEN {between(low, at)} ELSE {between(at + 1, high)} END"

        return between(0, len(self.cuts))

    def seen(self, bins: np.ndarray) -> np.ndarray:
        if self.cuts is not None:
            return bins[:, None]
        return (bins[:, None] == np.arange(len(self.values))).astype(np.uint8)


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cuts(values: Sequence[float]) -> tuple[float, ...]:
    """Half way between neighbouring values."""
    ordered = sorted(values)
    halves = [(a, a + (b - a) / 2, b) for a, b in zip(ordered, ordered[1:])]
    return tuple(mid if a <= mid < b else a for a, mid, b in halves)


def fit_axes(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[Axis] | None:
    """Bins from the training rows (numbers in their ``__scaled`` columns): one per value up to ``BINS`` values, else of about equal counts.
    None if a category has too many values."""
    axes = []
    buckets = bucket_counts(train, [f"{c}__scaled" for c in numeric]) if numeric else None
    for i, c in enumerate(numeric):
        cuts = None if buckets is None else _bucket_cuts(buckets[buckets["column"] == i])
        axes.append(Axis(c, _sketched_cuts(train, f"{c}__scaled") if cuts is None else cuts))
    if categorical:
        about = train.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
        if any(about[c] > WIDE for c in categorical):
            return None
        sets = train.agg(*[F.collect_set(c).alias(c) for c in categorical]).first()
        axes += [Axis(c, None, tuple(sorted(sets[c]))) for c in categorical]
    return axes


def _bucket_cuts(buckets: pd.DataFrame) -> tuple[float, ...] | None:
    """Cuts after every ``BINS``-th part of the rows, at borders of buckets. None if a bucket with several values holds too much of them."""
    n, low, high = (buckets[c].to_numpy() for c in ("n", "lo", "hi"))
    single = low == high
    if len(n) <= BINS and single.all():
        return _cuts(low.tolist())
    if len(n) <= BINS or (n[~single] > n.sum() / (4 * BINS)).any():
        return None
    after = np.searchsorted(np.cumsum(n), n.sum() * np.arange(1, BINS) / BINS)
    return tuple(sorted({float(high[k]) for k in after if k < len(n) - 1}))


def _sketched_cuts(train: DataFrame, column: str) -> tuple[float, ...]:
    """The same by a sketch, for columns of which a standard deviation says little."""
    known = train.select(F.col(column).alias("v")).where("v is not null and not isnan(v)")
    few = [r[0] for r in known.distinct().limit(BINS + 1).collect()]
    if len(few) <= BINS:
        return _cuts(few)
    found = known.agg(F.percentile_approx("v", F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), SKETCH), F.max("v")).first()
    return tuple(sorted({v for v in found[0] if v < found[1]}))


@dataclass(frozen=True)
class Cells:
    """Rows by cell and class. ``codes`` are the cells that have rows, ascending; a code's last axis varies fastest."""

    axes: tuple[Axis, ...]
    codes: np.ndarray
    counts: np.ndarray

    @property
    def size(self) -> int:
        return math.prod(a.size for a in self.axes)

    @property
    def weights(self) -> np.ndarray:
        """Balanced class weights, 0 for a class without rows (see balance_weights)."""
        by_class = self.counts.sum(axis=0)
        return np.divide(by_class.sum(), (by_class > 0).sum() * by_class, out=np.zeros(len(by_class)), where=by_class > 0)

    def strides(self) -> list[int]:
        return [math.prod(a.size for a in self.axes[i + 1:]) for i in range(len(self.axes))]

    def seen(self, codes: np.ndarray) -> np.ndarray:
        """What trees see of cells: a row of small numbers per cell."""
        parts = [a.seen((codes // stride % a.size).astype(np.uint8)) for a, stride in zip(self.axes, self.strides())]
        return np.asfortranarray(np.concatenate(parts, axis=1))

    def binner(self) -> SQLTransformer:
        """Adds the code of a row's cell."""
        code = " + ".join(f"CAST({a.bin_sql()} AS BIGINT) * {stride}" for a, stride in zip(self.axes, self.strides()))
        return SQLTransformer(statement=f"SELECT *, {code} AS {CELL} FROM __THIS__")

    @property
    def places(self) -> dict[str, tuple[int, int]]:
        """Stride and size of each feature's part of the code."""
        return {a.feature: (stride, a.size) for a, stride in zip(self.axes, self.strides())}

    def of(self, features: Sequence[str]) -> Cells:
        """The same rows by some of the axes."""
        kept = [(a, s) for a, s in zip(self.axes, self.strides()) if a.feature in features]
        code = np.zeros(len(self.codes), np.int64)
        for axis, stride in kept:
            code = code * axis.size + self.codes // stride % axis.size
        codes, place = np.unique(code, return_inverse=True)
        counts = np.zeros((len(codes), self.counts.shape[1]), np.int64)
        np.add.at(counts, place, self.counts)
        return Cells(tuple(a for a, _ in kept), codes, counts)


def count_cells(train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> Cells | None:
    """All rows that have a label, by cell and class. None where the grid is too large; rows are then needed one by one."""
    axes = fit_axes(train, numeric, categorical)
    if axes is None or math.prod(a.size for a in axes) > GRID or sum(a.width for a in axes) > WIDE:
        return None
    binner = Cells(tuple(axes), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)).binner()
    counted = stored(binner.transform(train.where(F.col(label).isNotNull())).groupBy(CELL, label).agg(F.count(F.lit(1)).alias("n")))
    top = counted.agg(F.max(label)).first()[0]
    if top is None:
        raise ValueError("no row has a label")
    classes = int(top) + 1
    if math.prod(a.size for a in axes) * classes > SCORES:
        return None
    rows = counted.select(CELL, F.col(label).cast("int").alias("k"), "n").toArrow()
    code, klass, n = (rows.column(i).to_numpy() for i in range(3))
    codes, place = np.unique(code, return_inverse=True)
    counts = np.zeros((len(codes), classes), np.int64)
    counts[place, klass] = n
    return Cells(tuple(axes), codes, counts)


#: Share of a node's score below which a gain is rounding.
ROUNDING = 1e-12


def grown(
    x: np.ndarray, rows: np.ndarray, sums: np.ndarray, score: Callable[[np.ndarray], np.ndarray], value: Callable[[np.ndarray], np.ndarray], depth: int, least: int = 1,
    subset: int | None = None, rng: np.random.Generator | None = None,
) -> Tree:
    """A tree level by level. ``sums`` has additive sums per cell, and a split gains ``score(left) + score(right) - score(both)``;
    each side has ``least`` rows or more. ``subset`` features are drawn for every node."""
    features = x.shape[1]
    live = np.flatnonzero(rows > 0)
    # Columns of the cells still in play; cells in leaves are dropped level by level.
    columns, rows, parts = [x[live, f] for f in range(features)], rows[live], [s[live] for s in sums.T]
    bins = [int(c.max(initial=0)) + 1 for c in columns]
    node = np.zeros(len(live), np.int64)
    m, first, levels = 1, 0, []
    while m:
        n = np.bincount(node, rows, m)
        total = np.stack([np.bincount(node, s, m) for s in parts], axis=1)
        own = score(total)
        gain, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        if len(levels) < depth:
            drawn = None
            if subset is not None and subset < features:
                drawn = np.zeros((m, features), bool)
                np.put_along_axis(drawn, np.argsort(rng.random((m, features)), axis=1)[:, :subset], True, axis=1)
            for f in range(features):
                if bins[f] < 2:
                    continue
                if drawn is None:
                    some = (node, columns[f], rows, parts)
                else:
                    at = np.flatnonzero(drawn[:, f][node])
                    some = (node[at], columns[f][at], rows[at], [s[at] for s in parts])
                if not len(some[0]):
                    continue
                nodes, bin_, left_n, left = _left(*some, m, bins[f])
                right_n, right = n[nodes] - left_n, total[nodes] - left
                both = score(left) + score(right)
                gains = both - own[nodes]
                gains = np.where((left_n >= least) & (right_n >= least) & (gains > ROUNDING * np.abs(both)), gains, -1.0)
                starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
                most = np.maximum.reduceat(gains, starts)
                hits = np.flatnonzero(gains == np.repeat(most, np.diff(np.r_[starts, len(nodes)])))
                hits = hits[np.searchsorted(hits, starts)]
                hits = hits[most > gain[nodes[hits]]]
                better = nodes[hits]
                gain[better], feature[better], cut[better] = gains[hits], f, bin_[hits]
        split = feature >= 0
        rank = np.cumsum(split) - 1
        child = np.where(split, first + m + 2 * rank, 0)
        levels.append((feature, cut, child, np.where(split, child + 1, 0), value(total)))
        if not split.all():
            stays = np.flatnonzero(split[node])
            node, columns, rows, parts = node[stays], [c[stays] for c in columns], rows[stays], [s[stays] for s in parts]
        right = np.zeros(len(node), bool)
        by = feature[node]
        for f in range(features):
            at = np.flatnonzero(by == f)
            right[at] = columns[f][at] > cut[node[at]]
        node = 2 * rank[node] + right
        first, m = first + m, 2 * int(split.sum())
    return Tree(*(np.concatenate(part) for part in zip(*levels)))


def _left(node: np.ndarray, bin_: np.ndarray, rows: np.ndarray, sums: Sequence[np.ndarray], m: int, size: int) -> tuple[np.ndarray, ...]:
    """Possible cuts, by node and bin: node, bin, and rows and sums up to the bin."""
    key = node * size + bin_
    if m * size <= 2 * len(node):  # few nodes: a table of all bins
        table = lambda v: np.bincount(key, v, m * size).reshape(m, size).cumsum(axis=1)[:, :-1].ravel()
        nodes, bins = np.repeat(np.arange(m), size - 1), np.tile(np.arange(size - 1), m)
        return nodes, bins, table(rows), np.stack([table(s) for s in sums], axis=1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    nodes, bins = key[ends] // size, key[ends] % size
    # Running totals over all nodes, less those of the nodes before.
    changes = np.r_[True, nodes[1:] != nodes[:-1]]
    group = np.cumsum(changes) - 1

    def inside(v: np.ndarray) -> np.ndarray:
        running = v[order].cumsum()[ends]
        before = np.r_[running[:1] * 0, running[:-1]][changes]
        return running - before[group]

    return nodes, bins, inside(rows), np.stack([inside(s) for s in sums], axis=1)


def _over(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.divide(top, below, out=np.zeros(np.broadcast(top, below).shape), where=below > 0)


def _class_tree(x: np.ndarray, counts: np.ndarray, weights: np.ndarray, settings: Mapping[str, float], subset: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """Gini impurity on weighted counts; a leaf holds the classes' weighted shares."""

    def score(total: np.ndarray) -> np.ndarray:
        weighted = total * weights
        return _over((weighted * weighted).sum(axis=-1), weighted.sum(axis=-1))

    def shares(total: np.ndarray) -> np.ndarray:
        weighted = total * weights
        return _over(weighted, weighted.sum(axis=-1, keepdims=True))

    return grown(x, counts.sum(axis=1), counts, score, shares, int(settings["maxDepth"]), int(settings.get("minInstancesPerNode", 1)), subset, rng)


def _boosted(x: np.ndarray, counts: np.ndarray, weights: np.ndarray, klass: int, settings: Mapping[str, float]) -> Iterator[Tree]:
    """Trees of binary boosting with logistic loss, ``klass`` against the rest, their values times their weight. The first one fits the labels (1 and -1)
    with weight 1, the others the pseudo-residuals with the step."""
    rng = np.random.default_rng([SEED, klass])
    margin, share = np.zeros(len(x)), settings.get("subsamplingRate", 1.0)
    score = lambda total: _over(total[..., 1] ** 2, total[..., 0])
    for k in range(int(settings["maxIter"])):
        drawn = counts if share >= 1 else rng.binomial(counts, share)
        weighted = drawn * weights
        yes, no = weighted[:, klass], weighted.sum(axis=1) - weighted[:, klass]
        # In effect the residual of a row of the class is 4 / (1 + exp(2 F)), of any other one -4 / (1 + exp(-2 F)).
        up, down = (1.0, 1.0) if k == 0 else (4 * _logistic(-2 * margin), 4 * _logistic(2 * margin))
        sums = np.stack([yes + no, yes * up - no * down], axis=1)
        step = 1.0 if k == 0 else settings["stepSize"]
        tree = grown(
            x, drawn.sum(axis=1), sums, score, lambda total: step * _over(total[..., 1], total[..., 0]), int(settings["maxDepth"]), int(settings.get("minInstancesPerNode", 1))
        )
        margin += tree.added(x)
        yield tree


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-v, -700, 700)))


def _grid_scores(kind: str, settings: Mapping[str, float], cells: Cells, task: int, tasks: int) -> np.ndarray:
    """Scores by class of every cell of the grid, as far as the trees of one task go."""
    x, weights = cells.seen(cells.codes), cells.weights
    grid = cells.seen(np.arange(cells.size))
    scores = np.zeros((len(grid), len(weights)))
    if kind == "boosting":
        for tree in _boosted(x, cells.counts, weights, task, settings):
            scores[:, task] += tree.added(grid)
        return scores
    if kind == "arvore_decisao":
        return _class_tree(x, cells.counts, weights, settings).added(grid)
    # Features per node as Spark ML draws them for a forest of classification trees, all for a single tree.
    subset = math.ceil(math.sqrt(x.shape[1])) if settings["numTrees"] > 1 else None
    for k in range(task, int(settings["numTrees"]), tasks):
        rng = np.random.default_rng([SEED, k])
        drawn = rng.poisson(cells.counts) if settings["numTrees"] > 1 else cells.counts
        if drawn.any():
            scores += _class_tree(x, drawn, weights, settings, subset, rng).added(grid)
    return scores


#: Cells in a batch that a task hands on.
BATCH = 200_000


def fit_cells(spark: SparkSession, kind: str, settings: Mapping[str, float], cells: Cells) -> CellModel:
    """The classifier fitted on counts: forests add up their trees' shares, boosting takes the class of the largest margin."""
    sc, classes = spark.sparkContext, cells.counts.shape[1]
    tasks = {"boosting": classes, "arvore_decisao": 1, "random_forest": min(int(settings.get("numTrees", 1)), max(8, sc.defaultParallelism))}[kind]
    sent, settings = sc.broadcast(cells), dict(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch["id"]:
                scores = _grid_scores(kind, settings, sent.value, int(task), tasks)
                for start in range(0, len(scores), BATCH):
                    some = scores[start:start + BATCH]
                    yield pd.DataFrame({CELL: np.arange(start, start + len(some)), **{f"s{k}": some[:, k] for k in range(classes)}})

    columns = [f"s{k}" for k in range(classes)]
    parts = spark.range(0, tasks, 1, tasks).mapInPandas(run, f"{CELL} bigint, {', '.join(f'{c} double' for c in columns)}")
    if tasks > 1:
        parts = parts.groupBy(CELL).agg(*[F.sum(c).alias(c) for c in columns])
    scores = F.array(*columns)
    table = stored(parts.select(CELL, (F.array_position(scores, F.array_max(scores)) - 1).cast("double").alias("prediction")))
    sent.unpersist()
    return CellModel(table, cells.places)


class CellModel(Transformer, MLWritable, MLReadable):
    """The class of every cell, joined to rows that carry the code of theirs (see :meth:`Cells.binner`)."""

    def __init__(self, table: DataFrame | None = None, places: Mapping[str, tuple[int, int]] | None = None):
        super().__init__()
        self.table, self.places = table, dict(places or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(F.broadcast(self.table), CELL, "left")

    def recoded(self, places: Mapping[str, tuple[int, int]]) -> Column:
        """The code in this model's grid of a cell of a grid with all its features, by their ``places`` there."""
        return F.expr(" + ".join(f"(`{CELL}` div {places[f][0]}) % {size} * {stride}" for f, (stride, size) in self.places.items()))

    def part(self, feature: str, cell: str = CELL) -> Column:
        """A feature's part of the code."""
        stride, size = self.places[feature]
        return F.expr(f"(`{cell}` div {stride}) % {size} * {stride}")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CellModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"places": self.model.places})
        self.model.table.write.parquet(f"{path}/cells")


class _Reader(MLReader):
    def load(self, path: str) -> CellModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CellModel(self.sparkSession.read.parquet(f"{path}/cells"), {f: tuple(p) for f, p in metadata["places"].items()})
        model._resetUid(metadata["uid"])
        return model
