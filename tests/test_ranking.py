"""Ranks, quantiles and carries must not depend on how a group is cut, nor on its size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolake.functions import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    # one group holds most rows, half of them one value
    g = np.where(rng.random(4000) < 0.8, 0, rng.integers(1, 30, 4000))
    v = np.where(rng.random(4000) < 0.5, 7.0, rng.normal(size=4000))
    return pd.DataFrame({"g": g, "v": v, "id": np.arange(4000)})


def test_grouped_rank_matches_pandas(spark, skewed):
    got = R.grouped_rank(spark.createDataFrame(skewed).repartition(7), ["g"], ["v", "id"], "rk").toPandas()
    want = skewed.sort_values(["g", "v", "id"])
    want["rk"] = want.groupby("g").cumcount()
    m = got.merge(want, on="id")
    assert len(m) == 4000 and (m.rk_x == m.rk_y).all()


def test_quantiles_are_exact(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("w", F.when((F.col("id") % 3 > 0) & (F.col("g") != 5), F.col("v") * 2))
    df = df.unionAll(spark.createDataFrame([(None, 1.0, 9000, None), (None, 3.0, 9001, 4.0)], df.schema))
    got = R.quantiles(df, ["g"], ["v", "w"], [0.0, 0.25, 0.5, 0.98], extra=[F.max("v").alias("m")]).toPandas()
    none = got[got.g.isna()].iloc[0]
    assert none.n == 2 and none.m == 3 and none.v_q[2] == 2 and list(none.w_q) == [4] * 4
    got = got[got.g.notna()].set_index("g")
    for g, part in skewed.groupby("g"):
        assert got.loc[g, "n"] == len(part) and got.loc[g, "m"] == part.v.max()
        np.testing.assert_allclose(got.loc[g, "v_q"], np.quantile(part.v, [0, 0.25, 0.5, 0.98]), atol=1e-12)
        w = part.v[part.id % 3 > 0] * 2
        if g == 5:
            assert got.loc[g, "w_q"] is None
        else:
            np.testing.assert_allclose(got.loc[g, "w_q"], np.quantile(w, [0, 0.25, 0.5, 0.98]), atol=1e-12)


def test_quantiles_of_one_repeated_value_stay_spread(spark, monkeypatch):
    placed, keep = [], R._placed
    monkeypatch.setattr(R, "_placed", lambda *a: placed.append(keep(*a)) or placed[-1])
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id")).alias("v"))
    assert R.quantiles(df, ["g"], ["v"], [0.5, 1.0]).first().v_q == [0.0, 39_990.0]
    sizes = [r["count"] for r in placed[0].groupBy("__part").count().collect()]
    assert sum(sizes) == 4_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)  # distinct values, evenly placed


def test_cap_keeps_lowest(spark, skewed):
    got = R.cap_per_group(spark.createDataFrame(skewed), ["g"], ["v", "id"], 5).toPandas()
    want = skewed.sort_values(["v", "id"]).groupby("g").head(5)
    assert set(got.id) == set(want.id)


def test_running_sum_and_surrounding(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = R.grouped_running_sum(df, ["g"], ["id"], "v", "s").toPandas().sort_values("id")
    want = skewed.sort_values("id").groupby("g").v.cumsum() - skewed.v
    np.testing.assert_allclose(got.s.to_numpy(), want.to_numpy(), atol=1e-9)
    marked = df.withColumn("m", F.when(F.col("id") % 50 == 0, F.col("id")))
    near = R.surrounding(marked, ["g"], ["id"], "m", "p", "n").toPandas().sort_values("id")
    s = skewed.sort_values("id").assign(m=lambda d: d.id.where(d.id % 50 == 0))
    pd.testing.assert_series_equal(near.p.reset_index(drop=True), s.groupby("g").m.ffill().reset_index(drop=True), check_names=False)
    nxt = s.groupby("g").m.transform(lambda c: c.shift(-1).bfill())
    pd.testing.assert_series_equal(near.n.reset_index(drop=True), nxt.reset_index(drop=True), check_names=False)
