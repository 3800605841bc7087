"""Registered queries of the leaf-wise trainer, with SQL that trains the same trees step by step.

The registered model is short (`TREES` trees of `LEAVES` leaves on `BINS` bins, all rows and inputs for each tree) so that
SQL can repeat it: every split is one table expression. Training, scoring and the model table are the library's own.
Inputs are rounded first, since two engines add windows in different orders.
"""

from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import boosting, learning
from hourgrid.plans.oracle import R, T
from hourgrid.session import stored

TREES, LEAVES, BINS, DIGITS = 3, 4, 16, 6
VERSION = "leafwise-v1"


def _rounded(rows):
    return rows.withColumns({n: F.round(F.col(n).cast("double"), DIGITS) for n in S.MODEL_FEATURES})


def _labelled(ws):
    return learning.chronological_split(stored(_rounded(ws.labelled), "labelled"), ws.train_end)


def _model(ws):
    train, _ = _labelled(ws)
    return boosting.fit_leafwise(train, trees=TREES, leaves=LEAVES, bins=BINS, sampling=1.0)


def _table(ws):
    return _model(ws).table(ws.spark).select(
        F.col("tree").cast("bigint").alias("tree"), "node", "feature", "threshold", "gain", "rows", "value")


def _scores(ws):
    """Risk rows by the model as it is read back from its stored table."""
    model = boosting.LeafwiseModel.from_table(stored(_model(ws).table(ws.spark), "model"))
    learning.require_model_schema(model, ws.features)
    return learning.risk_rows(learning.with_probability(model, _rounded(learning.require_scorable(ws.features))), VERSION)


def _evaluation(ws):
    """Counts of the later part at every threshold of the sweep."""
    train, test = _labelled(ws)
    model = boosting.fit_leafwise(train, trees=TREES, leaves=LEAVES, bins=BINS, sampling=1.0)
    scored = learning.with_probability(model, test).withColumn(
        "prediction_probability", F.round("prediction_probability", DIGITS))
    return learning.threshold_sweep(scored).select("threshold", "tp", "fp", "accuracy", "recall")


def training_sql(answer: str) -> str:
    """`answer` over the trees: cand_t_s (split s of tree t), leaf_t (rows and value of its leaves), s_t (scores after it)."""
    unit, rate = "16777216.0::DOUBLE", f"{boosting.RATE}::DOUBLE"
    inputs = " UNION ALL ".join(
        f"SELECT id, {f} AS f, round(CAST({n} AS DOUBLE), {DIGITS}) AS v FROM all_rows" for f, n in enumerate(S.MODEL_FEATURES))
    parts = [
        """all_rows AS MATERIALIZED (SELECT f.*, row_number() OVER (ORDER BY f.grid_id, f.feature_timestamp) AS id, l.high AS y,
           coalesce(l.prediction_timestamp <= e.train_end, false) AS train, l.prediction_timestamp > e.train_end AS test
           FROM features f CROSS JOIN train_end e LEFT JOIN (SELECT grid_id AS g, feature_timestamp AS ft, high, prediction_timestamp
           FROM labelled) l ON l.g = f.grid_id AND l.ft = f.feature_timestamp)""",
        f"long AS MATERIALIZED ({inputs})",
        f"""cuts AS MATERIALIZED (SELECT f, k, v AS cut FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn,
            count(*) OVER (PARTITION BY f) AS n FROM long JOIN all_rows USING (id) WHERE train) o
            JOIN range(1, {BINS}) t(k) ON rn = greatest(1, ceil(k * n / {BINS}.0::DOUBLE)))""",
        "binned AS MATERIALIZED (SELECT l.id, l.f, count(*) FILTER (c.cut < l.v) AS b FROM long l JOIN cuts c ON c.f = l.f GROUP BY l.id, l.f)",
        # Without both classes there are no trees; without rows the start is a half.
        f"""share AS MATERIALIZED (SELECT greatest({boosting.EDGE}, least(1 - {boosting.EDGE}::DOUBLE, coalesce(avg(y), 0.5::DOUBLE))) AS p,
            coalesce(min(y) <> max(y), false) AS mixed FROM all_rows WHERE train)""",
        "s_0 AS MATERIALIZED (SELECT id, y, train AND mixed AS train, ln(p / (1 - p)) AS s FROM all_rows CROSS JOIN share)",
    ]
    for t in range(1, TREES + 1):
        parts += [
            f"""grad_{t} AS MATERIALIZED (SELECT id, train, CAST(round((p - y) * {unit}) AS BIGINT) AS g, CAST(round(p * (1 - p) * {unit}) AS BIGINT) AS h
                FROM (SELECT id, y, train, 1::DOUBLE / (1::DOUBLE + exp(-s)) AS p FROM s_{t - 1}) q)""",
            f"node_{t}_0 AS MATERIALIZED (SELECT id, 1::BIGINT AS node FROM all_rows)",
        ]
        for s in range(1, LEAVES):
            so_far = "PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING"
            every = "PARTITION BY node, f"
            parts += [
                f"""cand_{t}_{s} AS MATERIALIZED (SELECT node, f, b, gain, n FROM (SELECT *, gl * gl / hl + gr * gr / hr - g * g / h AS gain
                    FROM (SELECT node, f, b, nl, n - nl AS nr, n, gl / {unit} AS gl, hl / {unit} AS hl, (ga - gl) / {unit} AS gr,
                      (ha - hl) / {unit} AS hr, ga / {unit} AS g, ha / {unit} AS h
                      FROM (SELECT node, f, b, CAST(sum(g) OVER ({so_far}) AS BIGINT) AS gl, CAST(sum(h) OVER ({so_far}) AS BIGINT) AS hl,
                        CAST(sum(c) OVER ({so_far}) AS BIGINT) AS nl, CAST(sum(g) OVER ({every}) AS BIGINT) AS ga,
                        CAST(sum(h) OVER ({every}) AS BIGINT) AS ha, CAST(sum(c) OVER ({every}) AS BIGINT) AS n
                        FROM (SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS c FROM node_{t}_{s - 1} JOIN grad_{t} USING (id)
                          JOIN binned USING (id) WHERE train GROUP BY node, f, b) a) b_) c_
                    WHERE nl >= {boosting.MIN_ROWS} AND nr >= {boosting.MIN_ROWS} AND hl >= {boosting.MIN_HESSIAN} AND hr >= {boosting.MIN_HESSIAN}) d
                    WHERE gain > {boosting.MIN_GAIN} ORDER BY gain DESC, node, f, b LIMIT 1)""",
                f"""node_{t}_{s} AS MATERIALIZED (SELECT n.id, CASE WHEN c.node = n.node THEN 2 * n.node + CASE WHEN b.b > c.b THEN 1 ELSE 0 END
                    ELSE n.node END AS node FROM node_{t}_{s - 1} n LEFT JOIN cand_{t}_{s} c ON true
                    LEFT JOIN binned b ON b.id = n.id AND b.f = c.f)""",
            ]
        parts += [
            f"""leaf_{t} AS MATERIALIZED (SELECT node, count(*) AS rows, -{rate} * ((CAST(sum(g) AS BIGINT) / {unit}) / (CAST(sum(h) AS BIGINT) / {unit})) AS value
                FROM node_{t}_{LEAVES - 1} JOIN grad_{t} USING (id) WHERE train GROUP BY node)""",
            f"""s_{t} AS MATERIALIZED (SELECT p.id, p.y, p.train, p.s + coalesce(l.value, 0) AS s FROM s_{t - 1} p JOIN node_{t}_{LEAVES - 1} n ON n.id = p.id
                LEFT JOIN leaf_{t} l ON l.node = n.node)""",
        ]
    return f"SELECT q.* FROM (WITH {', '.join(parts)} {answer}) q"


NAMES = "[" + ", ".join(f"'{n}'" for n in S.MODEL_FEATURES) + "]"
SPLITS = " UNION ALL ".join(
    f"SELECT {t} AS tree, * FROM cand_{t}_{s}" for t in range(1, TREES + 1) for s in range(1, LEAVES))
LEAF_ROWS = " UNION ALL ".join(
    f"SELECT {t}, node, NULL, NULL, NULL, rows, {R('value')} FROM leaf_{t}" for t in range(1, TREES + 1))
FINAL = f"(SELECT a.*, 1::DOUBLE / (1::DOUBLE + exp(-s.s)) AS risk FROM all_rows a JOIN s_{TREES} s ON s.id = a.id)"

QUERIES = {
    "leafwise_model": (
        lambda ws: _table(ws.stored),
        training_sql(f"""SELECT 0::BIGINT AS tree, 1::BIGINT AS node, CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS DOUBLE) AS threshold,
            CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS BIGINT) AS rows, {R('ln(p / (1 - p))')} AS value FROM share
            UNION ALL SELECT tree, node, {NAMES}[x.f + 1], {R('cut')}, {R('gain')}, n, NULL FROM ({SPLITS}) x JOIN cuts c ON c.f = x.f AND c.k = x.b + 1
            UNION ALL {LEAF_ROWS}""")),
    "leafwise_scores": (
        lambda ws: _scores(ws.stored),
        training_sql(f"""SELECT grid_id, {T('feature_timestamp')} AS timestamp, {R('risk')} AS risk_score,
            CASE WHEN risk >= 0.8 THEN 'HIGH' WHEN risk >= 0.5 THEN 'ATTENTION' ELSE 'LOW' END AS risk_level,
            '{VERSION}' AS model_version FROM {FINAL} r""")),
    "leafwise_importance": (
        lambda ws: learning.feature_importance(_model(ws.stored)),
        training_sql(f"""SELECT x.name AS feature, CAST(count(y.f) AS DOUBLE) AS importance
            FROM (SELECT unnest({NAMES}) AS name, unnest(range({len(S.MODEL_FEATURES)})) AS f) x LEFT JOIN ({SPLITS}) y ON y.f = x.f GROUP BY x.name""")),
    "leafwise_sweep": (
        lambda ws: _evaluation(ws.stored),
        training_sql(f"""SELECT {R('threshold')} AS threshold, tp, fp, {R('(tp + neg - fp) / (pos + neg)')} AS accuracy, {R('tp / pos')} AS recall
            FROM (SELECT 0.1::DOUBLE + k * 0.01::DOUBLE AS threshold, count(*) FILTER (y = 1 AND p >= 0.1::DOUBLE + k * 0.01::DOUBLE) AS tp,
              count(*) FILTER (y = 0 AND p >= 0.1::DOUBLE + k * 0.01::DOUBLE) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
              FROM (SELECT y, round(risk, {DIGITS}) AS p FROM {FINAL} r WHERE test) u CROSS JOIN range(0, 81) t(k) GROUP BY k) v""")),
}
