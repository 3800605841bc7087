"""Quantiles, keys and geometry against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid.functions import columns as C, geometry as G
from hourgrid.functions.keys import dense_keys, text_ranges
from hourgrid.functions.quantiles import bucket_median, exact_percentile, leave_one_out_median


def _buckets(seed):
    rng = random.Random(seed)
    rows = []
    for size in [1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 24, 25]:
        key = len(rows)
        rows += [(f"b{key}", i, round(rng.choice([0.0, 1.0, rng.random() * 9]), 2)) for i in range(size)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_leave_one_out_median(frame, seed):
    rows = _buckets(seed)
    got = leave_one_out_median(frame(rows, "b string, i int, x double"), ["b"], "x", "m").toPandas()
    assert len(got) == len(rows)
    groups = {b: g for b, g in pd.DataFrame(rows, columns=["b", "i", "x"]).groupby("b")}
    for r in got.itertuples():
        others = groups[r.b][groups[r.b].i != r.i].x
        assert (pd.isna(r.m) and others.empty) or r.m == others.median()


def test_bucket_median(frame):
    rows = _buckets(3)
    got = bucket_median(frame(rows, "b string, i int, x double"), ["b"], "x", "m").toPandas()
    want = got.groupby("b").x.transform("median")
    assert (got.m == want).all()


@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 0.5, 1.0])
@pytest.mark.parametrize("kind", ["plain", "ties", "tiny"])
def test_exact_percentile(spark, share, kind):
    rng = np.random.default_rng(7)
    values = {
        "plain": rng.exponential(50, 4001),
        "ties": np.r_[np.zeros(3000), rng.random(1500), np.full(2500, 0.5)],
        "tiny": np.array([3.0, 1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    want = np.quantile(values, share)
    assert exact_percentile(df, "x", share, "p").first()["p"] == pytest.approx(want, abs=1e-12)
    for ranges in (2, 50):
        assert exact_percentile(df, "x", share, "p", ranges).first()["p"] == pytest.approx(want, abs=1e-12)


def test_exact_percentile_of_a_million_rows(spark):
    df = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 7).alias("x"))
    want = np.quantile(df.toPandas().x.to_numpy(), 0.1)
    assert exact_percentile(df, "x", 0.1, "p").first()["p"] == pytest.approx(want, rel=1e-12)


def test_exact_percentile_of_nothing(frame):
    assert exact_percentile(frame([], "x double"), "x", 0.1, "p").first()["p"] is None


def test_dense_keys_follow_text_order(spark):
    ids = spark.range(1, 1201).select(F.col("id").cast("string").alias("g"))
    got = dense_keys(ids, ["g"], "k", F.substring("g", 1, 2)).toPandas().sort_values("k")
    assert list(got.k) == list(range(1, 1201))
    assert list(got.g) == sorted(str(i) for i in range(1, 1201))


@pytest.mark.parametrize("template", ["MI-%06d", "%d", "ä%d", "x"])
def test_keys_by_text_ranges(spark, template):
    ids = spark.createDataFrame([(template % i if "%" in template else template + "y" * i,) for i in range(700)], "g string")
    placed = text_ranges(ids, "g")
    got = dense_keys(placed, ["g"], "k", None).toPandas().sort_values("k")
    assert list(got.k) == list(range(1, 701)) and list(got.g) == sorted(got.g, key=str.encode)
    if "%06d" in template:  # one common prefix still spreads over the ranges
        sizes = placed.groupBy("_bucket").count().toPandas()["count"]
        assert len(sizes) >= 4 and sizes.max() < 300


def test_keys_of_nothing_and_of_one(frame):
    assert dense_keys(text_ranges(frame([], "g string"), "g"), ["g"], "k", None).count() == 0
    assert dense_keys(text_ranges(frame([("a",)], "g string"), "g"), ["g"], "k", None).first()["k"] == 1


def test_centroids(frame):
    ring = "[[0,0],[4,0],[4,2],[0,2],[0,0]]"
    rows = [("1", f'{{"type":"Polygon","coordinates":[{ring}]}}'),
            ("2", f'{{"type":"MultiPolygon","coordinates":[[{ring}]]}}'),
            ("3", '{"type":"Point","coordinates":[1,2]}')]
    df = frame(rows, "grid_id string, geometry string")
    both = df.select("grid_id", G.vertex_mean(G.outer_ring("geometry"), 0).alias("x"),
                     G.box_middle(G.outer_ring("geometry", ("Polygon",)), 1).alias("y"))
    got = {r["grid_id"]: (r["x"], r["y"]) for r in both.collect()}
    assert got == {"1": (1.6, 1.0), "2": (1.6, None), "3": (None, None)}


def test_safe_ratio(frame):
    rows = [(1.0, 2.0), (1.0, 0.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 1.0), (1.0, None)]
    df = frame(rows, "a double, b double").select(C.safe_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in df.collect()] == [0.5, 0.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("score,level", [
    (0.20, "LOW"), (0.50, "ATTENTION"), (0.79, "ATTENTION"), (0.80, "HIGH"), (1.00, "HIGH")])
def test_risk_level(frame, score, level):
    assert frame([(score,)], "s double").select(C.risk_level(F.col("s"))).first()[0] == level


def test_age_labels(frame):
    rows = [("2024-01-02 00:00:00",), ("2024-01-01 00:00:00",), ("2023-12-30 00:00:00",),
            ("2023-12-29 23:59:59",), (None,)]
    df = frame(rows, "t string").select(F.to_timestamp("t").alias("t"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    labels = [r[0] for r in df.select(C.age_label(F.col("t"), now)).collect()]
    assert labels == ["FRESH", "FRESH", "STALE", "VERY_STALE", "UNKNOWN"]
    health = [r[0] for r in df.select(C.health_label(F.col("t"), now)).collect()]
    assert health == ["healthy", "warning", "failure", "failure", "failure"]


def test_resolve_column(frame):
    df = frame([("1", 2.0)], "Grid_ID string, total_sms double")
    row = df.select(C.resolve_column(df, ["gridid", "grid_id"]).alias("g"),
                    C.resolve_column(df, ["calls"], 0.0).alias("c")).first()
    assert (row["g"], row["c"]) == ("1", 0.0)
    with pytest.raises(ValueError):
        C.resolve_column(df, ["absent"])
    with pytest.raises(ValueError, match="x, y"):
        C.require_columns(df, ["x", "Grid_ID", "y"])
