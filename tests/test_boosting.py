"""Leaf-wise trees against a direct best-first trainer, over layouts, in the stated cases, and read back."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import boosting, learning

NAMES = ["a", "b", "c"]


def frame(n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)  # many ties
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + rng.normal(0, 0.3, n) > 0.4).astype(int)
    return pd.DataFrame(x, columns=NAMES).assign(y=y)


def direct(df, trees, leaves, cuts, rate, least):
    """Best-first growth one split at a time, from the rows themselves; scores of the rows."""
    x, y = df[NAMES].to_numpy(), df.y.to_numpy()
    score = np.full(len(df), math.log(y.mean() / (1 - y.mean())))
    shapes = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = np.round((p - y) * boosting.UNIT) / boosting.UNIT, np.round(p * (1 - p) * boosting.UNIT) / boosting.UNIT
        node, splits = np.ones(len(df), dtype=int), {}

        def best(n):
            at, found = node == n, None
            for f in range(3):
                for cut in cuts[f]:
                    lo, hi = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                    if lo.sum() < least or hi.sum() < least:
                        continue
                    gain = sum(s * g[m].sum() ** 2 / h[m].sum() for s, m in ((1, lo), (1, hi), (-1, at)))
                    if gain > boosting.MIN_GAIN and (found is None or gain > found[0]):
                        found = (gain, f, cut)
            return found

        open_ = {1: best(1)}
        while len(splits) < leaves - 1 and any(open_.values()):
            n = max((k for k in open_ if open_[k]), key=lambda k: (open_[k][0], -k))
            _, f, cut = open_.pop(n)
            splits[n] = (NAMES[f], cut)
            node = np.where(node == n, 2 * n + (x[:, f] > cut), node)
            open_ |= {c: best(c) for c in (2 * n, 2 * n + 1)}
        for n in np.unique(node):
            score[node == n] += -rate * (g[node == n].sum() / h[node == n].sum())
        shapes.append(splits)
    return shapes, 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_equals_direct_growth(spark, leaves):
    df = frame()
    rows = spark.createDataFrame(df)
    model = boosting.fit_leafwise(rows, "y", NAMES, trees=2, leaves=leaves, bins=32, sampling=1.0, rate=0.3)
    shapes, want = direct(df, 2, leaves, boosting.bin_cuts(rows, NAMES, 32), 0.3, boosting.MIN_ROWS)
    assert [{n: (r["feature"], r["threshold"]) for n, r in t.items() if "feature" in r} for t in model.trees] == shapes
    got = model.with_probability(rows).toPandas().sort_values(NAMES + ["y"])
    want = df.assign(p=want).sort_values(NAMES + ["y"])
    assert got.prediction_probability.to_numpy() == pytest.approx(want.p.to_numpy(), abs=1e-9)


def test_layout_of_rows_does_not_matter(spark):
    rows = spark.createDataFrame(frame())
    one, many = (boosting.fit_leafwise(r, "y", NAMES, trees=3, leaves=6, bins=16)
                 for r in (rows.coalesce(1), rows.repartition(7, "c").sortWithinPartitions(F.desc("a"))))
    assert one == many and len(one.trees) == 3


def test_scores_go_on_behind_a_checkpoint(spark, monkeypatch):
    rows = spark.createDataFrame(frame(300))
    far = boosting.fit_leafwise(rows, "y", NAMES, trees=5, leaves=3, bins=8)
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    assert boosting.fit_leafwise(rows, "y", NAMES, trees=5, leaves=3, bins=8) == far


def test_model_is_its_table(spark, tmp_path):
    rows = spark.createDataFrame(frame(300))
    model = boosting.fit_leafwise(rows, "y", NAMES, trees=3, leaves=4, bins=8)
    model.table(spark).repartition(3).write.parquet(str(tmp_path / "m"))
    again = boosting.LeafwiseModel.from_table(spark.read.parquet(str(tmp_path / "m")))
    assert again == model
    used = learning.feature_importance(model).collect()
    assert sum(r["importance"] for r in used) == sum("feature" in r for t in model.trees for r in t.values())


def test_learns_better_than_chance(spark):
    train, test = frame(1500, 1), frame(800, 2)
    model = boosting.fit_leafwise(spark.createDataFrame(train), "y", NAMES, trees=12, leaves=8, bins=32, rate=0.3)
    scored = model.with_probability(spark.createDataFrame(test))
    assert learning.auc(scored, label="y").first()["auc"] > 0.9


def test_cases(spark):
    df = frame(200)
    schema = "a double, b double, c double, y int"
    rows = spark.createDataFrame(df).select(*NAMES, F.col("y").cast("int").alias("y"))
    fit = dict(label="y", names=NAMES, trees=2, leaves=4, bins=8, sampling=1.0)
    empty = boosting.fit_leafwise(spark.createDataFrame([], schema), **fit)
    assert (empty.start, empty.trees) == (0.0, [])
    ones = boosting.fit_leafwise(rows.filter("y = 1"), **fit)
    assert ones.trees == [] and ones.start > 30
    small = boosting.fit_leafwise(rows.limit(30).withColumn("y", (F.col("a") > 0).cast("int")), **fit)
    assert all(list(t) == [1] for t in small.trees)  # too few rows for two leaves of 20
    # Rows without a label change nothing; null goes left, NaN right; other columns are kept.
    more = rows.unionByName(rows.withColumn("y", F.lit(None).cast("int")))
    model = boosting.fit_leafwise(rows, **fit)
    assert boosting.fit_leafwise(more, **fit) == model
    name = model.trees[0][1]["feature"]
    odd = spark.createDataFrame([(k, v) for k, v in enumerate((None, -1e9, float("nan"), 1e9))], "k int, v double")
    scored = odd.select("k", *[(F.col("v") if n == name else F.lit(0.0)).alias(n) for n in NAMES])
    p = [r["prediction_probability"] for r in model.with_probability(scored).orderBy("k").collect()]
    assert p[0] == p[1] and p[2] == p[3]
    holes = rows.withColumn("a", F.when(F.col("b") > 0, F.col("a")))
    assert boosting.fit_leafwise(holes, **fit).trees
