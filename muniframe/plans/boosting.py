"""Gradient boosting with Poisson loss.

Each round a regression tree is grown on the gradients of the deviance, ``y - mu``. What a leaf adds is not the tree's own mean but the
closed-form optimum of the loss there, the logarithm of its total over its fitted total, from one sum by leaf; it is shrunk by the
step, and one constant then sets the fitted total to the actual one. Both follow from the sums by leaf, so a round is the tree and one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from ..session import stored

SEED = 42


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: feature (-1 at a leaf), threshold, children, and what a leaf adds to the logarithm."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def added(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.feature[node] >= 0).any():
            k = np.flatnonzero(inner)
            at = node[k]
            down = x[k, self.feature[at]] <= self.threshold[at]
            node[k] = np.where(down, self.left[at], self.right[at])
        return self.value[node]


def _grown(root, leaves: Sequence[float]) -> Tree:
    """Arrays of a fitted tree; leaves are numbered from left to right, as the model numbers them."""
    nodes: list[list[float]] = []
    values = iter(leaves)

    def visit(node) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[k][4] = next(values)
        else:
            split = node.split()
            nodes[k][:2] = [split.featureIndex(), split.threshold()]
            nodes[k][2] = visit(node.leftChild())
            nodes[k][3] = visit(node.rightChild())
        return k

    visit(root)
    feature, threshold, left, right, value = map(np.array, zip(*nodes))
    return Tree(feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float))


@dataclass(frozen=True)
class PoissonBoosting:
    """``base`` and the trees add up to the logarithm of the expected count. ``deviance`` holds it after each round, the constant model first;
    ``totals`` the fitted total after each round."""

    features: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]
    deviance: tuple[float, ...]
    totals: tuple[float, ...]

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """``df`` with the expected count; null where a feature is null."""
        columns, base, trees = list(self.features), self.base, self.trees
        kept = df.drop(out)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, `{out}` double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[columns].to_numpy(float, na_value=np.nan)
                total = base + sum((t.added(x) for t in trees), np.zeros(len(x)))
                batch[out] = np.where(np.isnan(x).any(axis=1), np.nan, np.exp(total))
                yield batch

        return kept.mapInPandas(run, schema).withColumn(out, F.nanvl(out, F.lit(None)))


def fit_poisson_boosting(
    df: DataFrame, features: Sequence[str], label: str = "y", rounds: int = 300, step: float = 0.05, depth: int = 5, min_rows: int = 20, seed: int = SEED
) -> PoissonBoosting:
    """Boosted trees for a count. Rows with a null feature or label are left out; labels must not be negative, and not all 0.

    After every round the fitted total is the actual one, and the deviance does not rise."""
    used = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__y")).dropna()
    total, n = used.agg(F.sum("__y"), F.count(F.lit(1))).first()
    if not total or total <= 0:
        raise ValueError("a count model needs a positive total")
    base = math.log(total / n)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(used)
    rows = stored(vectors.select("features", "__y", F.lit(base).alias("__f")))
    # Twice the log-likelihood's distance from the saturated model; y log y does not change.
    full = used.agg(F.sum(F.when(F.col("__y") > 0, F.col("__y") * F.log("__y") - F.col("__y")).otherwise(0.0))).first()[0]
    deviance, totals, trees = [2 * (full - (total * base - total))], [], []
    grower = DecisionTreeRegressor(featuresCol="features", labelCol="__gradient", predictionCol="__mean", leafCol="__leaf", maxDepth=depth, minInstancesPerNode=min_rows, seed=seed)
    for _ in range(rounds):
        state = rows.withColumn("__mu", F.exp("__f")).withColumn("__gradient", F.col("__y") - F.col("__mu"))
        tree = grower.fit(state)
        placed = tree.transform(state)
        sums = {int(r["__leaf"]): r for r in placed.groupBy("__leaf").agg(F.sum("__y").alias("y"), F.sum("__mu").alias("mu"), F.sum(F.col("__y") * F.col("__f")).alias("yf")).collect()}  # a row a leaf
        adds = {k: step * math.log(max(r["y"], 1e-9 * total) / r["mu"]) for k, r in sums.items()}
        constant = math.log(total / sum(r["mu"] * math.exp(adds[k]) for k, r in sums.items()))
        adds = {k: v + constant for k, v in adds.items()}
        likelihood = sum(r["yf"] + adds[k] * r["y"] for k, r in sums.items()) - total
        deviance.append(2 * (full - likelihood))
        totals.append(sum(r["mu"] * math.exp(adds[k]) for k, r in sums.items()))
        trees.append(_grown(tree._call_java("rootNode"), [adds.get(k, constant) for k in range(max(sums) + 1 + tree.numNodes)]))
        table = F.create_map(*[x for k, v in adds.items() for x in (F.lit(float(k)), F.lit(v))])
        rows = stored(placed.select("features", "__y", (F.col("__f") + table[F.col("__leaf")]).alias("__f")))
    return PoissonBoosting(tuple(features), base, tuple(trees), tuple(deviance), tuple(totals))
