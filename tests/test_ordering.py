import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from muniframe.operators import ordering
from muniframe.operators.joins import checked_join, outer_profile
from muniframe.session import stored
from muniframe.operators.ordering import exact_quantiles, fill_from_next, first_per_group, number_rows, rank_min, running_sum


@pytest.fixture(scope="module")
def pdf():
    rng = random.Random(7)
    # A third of the rows share one key and one value.
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(5)}", 1.0 if i % 3 == 0 else float(rng.randrange(20))) for i in range(600)]
    return pd.DataFrame(rows, columns=["id", "k", "v"])


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5).persist()


def test_number_rows(df, pdf):
    got = number_rows(df, [F.col("v").desc(), "id"], "n", by=["k"]).toPandas().set_index("id")["n"].sort_index()
    want = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True]).groupby("k").cumcount().add(1)
    want.index = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])["id"]
    assert got.tolist() == want.sort_index().tolist()
    assert sorted(r["n"] for r in number_rows(df, ["id"], "n").select("n").collect()) == list(range(1, 601))


def test_running_sum(df, pdf):
    got = running_sum(df, ["id"], "v", "s", by=["k"]).toPandas().sort_values("id")
    assert np.allclose(got["s"].to_numpy(), pdf.sort_values("id").groupby("k")["v"].cumsum().sort_index().to_numpy())


def test_rank_min(df, pdf):
    got = rank_min(df, "v", "r", by=["k"]).toPandas().sort_values("id")["r"]
    assert got.tolist() == pdf.groupby("k")["v"].rank(method="min", ascending=False).astype(int).tolist()


def test_exact_quantiles(df, pdf):
    probs = {"a": 0.05, "b": 0.5, "c": 0.77, "d": 1.0}
    row = exact_quantiles(df, "v", probs).first()
    assert [row[n] for n in probs] == pytest.approx([pdf["v"].quantile(p) for p in probs.values()])
    for r in exact_quantiles(df, "v", probs, by=["k"]).collect():
        part = pdf.loc[pdf["k"] == r["k"], "v"]
        assert [r[n] for n in probs] == pytest.approx([part.quantile(p) for p in probs.values()])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100), st.just(float("nan"))), min_size=1, max_size=40), st.floats(0, 1))
def test_exact_quantile_property(spark, values, p):
    clean = [v for v in values if v is not None and v == v]
    row = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"q": p}).first()
    assert row["q"] == (pytest.approx(float(np.quantile(clean, p)), abs=1e-9) if clean else None)


def test_fill_from_next(spark):
    rows = [(i, float(i) if i in (5, 6, 40) else None) for i in range(50)]
    got = fill_from_next(spark.createDataFrame(rows, "i int, v double").repartition(7), ["i"], ["v"]).orderBy("i").toPandas()["v"]
    want = pd.Series([r[1] for r in rows], dtype="float64").bfill()
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_first_per_group(df, pdf):
    got = first_per_group(df, ["k"], ["v", "id"]).toPandas().sort_values("k")["id"].tolist()
    assert got == pdf.sort_values(["v", "id"]).groupby("k").head(1).sort_values("k")["id"].tolist()


@pytest.mark.parametrize("inside,margin", [(2_000_000, 4), (3, 4), (2_000_000, 0)])
def test_quantiles_by_selection(spark, monkeypatch, inside, margin):
    """Brackets, too many values inside them, brackets that miss: always the exact quantile."""
    monkeypatch.setattr(ordering, "INSIDE", inside)
    monkeypatch.setattr(ordering, "MARGIN", margin)
    monkeypatch.setattr(ordering, "SKETCH", 10_000 if margin else 3)
    rng = random.Random(inside + margin)
    groups = {"few": [3.5], "two": [1.0, -2.0], "ties": [7.0] * 500 + [8.0, 9.0], None: [rng.gauss(0, 9) for _ in range(777)], "whole": [float(k % 50) for k in range(999)]}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None, float("nan")]] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: [r[n] for n in probs] for r in ordering.exact_quantiles(df, "x", probs, ["g"]).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(xs, list(probs.values()))))
    every = [x for xs in groups.values() for x in xs]
    one = ordering.exact_quantiles(df, "x", probs).collect()
    assert list(one[0]) == pytest.approx(list(np.quantile(every, list(probs.values())))) and len(one) == 1


@pytest.mark.parametrize("most", [10_000, 1])
def test_rows_of_a_group_stay_where_they_are(spark, monkeypatch, most):
    """Rows are not shuffled to meet their group's brackets, unless there are many groups; the quantiles are the same."""
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(ordering, "stored", keep)
    monkeypatch.setattr(ordering, "BROADCAST_GROUPS", most)
    got = ordering.exact_quantiles(spark.range(1000).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS x"), "x", {"m": 0.5}, ["g"])
    assert sorted(map(tuple, got.collect())) == [(0, 499.0), (1, 500.0)]
    assert ("strategy=broadcast" in "".join(plans)) == (most > 1)


def test_checks_read_nothing_twice(spark, tmp_path):
    for name in "abc":
        spark.range(5).selectExpr("id AS k", f"id AS {name}").write.parquet(str(tmp_path / name))
    a, b, c = (spark.read.parquet(str(tmp_path / n)) for n in "abc")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(checked_join(a, b, ["k"])) == 2 and scans(outer_profile([a, b, c], ["k"])) == 3
    twice = b.union(b.where("k = 3"))
    for bad in (checked_join(a, twice, ["k"], "left", "m:1"), outer_profile([a, twice], ["k"]), checked_join(twice, a, ["k"], "inner", "1:1")):
        with pytest.raises(Exception, match='is not unique.*"k":3'):
            bad.collect()
    assert checked_join(twice, a, ["k"], "inner", "m:1").count() == 6
    wide = outer_profile([a.where("k < 2"), b.where("k > 0"), c.where("false")], ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in wide] == [(0, 0, None, None), (1, 1, 1, None), (2, None, 2, None), (3, None, 3, None), (4, None, 4, None)]
