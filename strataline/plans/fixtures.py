"""Maps the given tables to the roles the operators expect (series, reference curve, points, predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.columns import rounded_to
from strataline.functions.series import index_series, with_length

KEYS = ["user_id"]
REF_KEYS = ["ref_id"]
ID = ["user_id", "row_idx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user of ``events``; 70 % known prefix, a log with gaps, a 3-D path."""
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 3.6e9
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", hours.alias("md"))
    rows = with_length(index_series(events, KEYS, ["ts", "event_id"]), KEYS, "n")
    user = F.col("user_id").cast("double")
    return rows.select(
        "user_id",
        "row_idx",
        "n",
        "md",
        "value",
        "event_id",
        "event_type",
        F.when(F.col("row_idx") < F.floor(F.col("n") * 7 / 10), F.col("value")).alias("tvt_input"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("gr"),
        (F.col("md") * F.cos(user)).alias("x"),
        (F.col("md") * F.sin(user)).alias("y"),
        (-F.col("md") / 10 + F.col("value") / 100).alias("z"),
        (F.col("user_id") % 25).alias("ref_id"),
        (F.lit(900.0) + F.col("value") % 100).alias("prior"),
    )


# Same rows in SQL: CTE "s".
SERIES = """
ev AS (SELECT event_id, user_id, event_type, value,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS md,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx,
        count(*) OVER (PARTITION BY user_id) AS n
      FROM events),
s AS (SELECT user_id, row_idx, n, md, value, event_id, event_type,
        CASE WHEN row_idx < (n * 7) // 10 THEN value END AS tvt_input,
        CASE WHEN event_type <> 'error' THEN value END AS gr,
        md * cos(user_id) AS x, md * sin(user_id) AS y, -md / 10 + value / 100 AS z,
        user_id % 25 AS ref_id, 900.0::DOUBLE + value % 100 AS prior,
        (n * 7) // 10 AS eval_start, row_idx >= (n * 7) // 10 AS is_eval
      FROM ev)"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference curve per brand of ``part``: position, log value, label. Positions may repeat."""
    part = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    return part.select(
        (brand % 25).alias("ref_id"),
        F.col("p_retailprice").alias("tvt"),
        F.col("p_size").cast("double").alias("gr"),
        F.col("p_type").alias("geology"),
        "p_partkey",
    )


REFERENCE = """
r0 AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 25 AS ref_id, p_retailprice AS tvt,
         CAST(p_size AS DOUBLE) AS gr, p_type AS geology, p_partkey FROM part),
r AS (SELECT ref_id, tvt, avg(gr) AS gr, min(geology) AS geology FROM r0 GROUP BY 1, 2),
seg AS (SELECT ref_id, tvt AS x0, gr AS y0, lead(tvt) OVER w AS x1, lead(gr) OVER w AS y1 FROM r
        WINDOW w AS (PARTITION BY ref_id ORDER BY tvt)),
rb AS (SELECT ref_id, min(tvt) AS lo, max(tvt) AS hi, arg_min(gr, tvt) AS ylo, arg_max(gr, tvt) AS yhi
       FROM r GROUP BY 1)"""


def interp_sql(alias: str, x: str, edge: str = "clamp") -> str:
    """Linear look-up of x in the reference; needs joins "b" (rb) and "g" (asof seg) in the FROM clause."""
    low = f"{alias}b.ylo" if edge == "clamp" else "NULL"
    high = f"{alias}b.yhi" if edge == "clamp" else f"CASE WHEN {x} = {alias}b.hi THEN {alias}b.yhi END"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {alias}b.lo THEN {low} WHEN {x} >= {alias}b.hi THEN {high} "
        f"ELSE {alias}g.y0 + ({alias}g.y1 - {alias}g.y0) * ({x} - {alias}g.x0) / ({alias}g.x1 - {alias}g.x0) END"
    )


def interp_from(alias: str, source: str, x: str, key: str) -> str:
    return (
        f"{source} LEFT JOIN rb {alias}b ON {alias}b.ref_id = {key} "
        f"ASOF LEFT JOIN seg {alias}g ON {alias}g.ref_id = {key} AND {x} >= {alias}g.x0"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three model columns next to the target, for the evaluation tail and the prefix alike."""
    return series(spark, sf_dir).withColumns(
        {
            "pred_a": F.col("value") * 0.9 + 1,
            "pred_b": F.col("value") * 1.05,
            "pred_c": F.lit(60.0) + F.col("row_idx") % 7,
        }
    )


PREDICTIONS = SERIES + """,
p AS (SELECT *, value * 0.9::DOUBLE + 1 AS pred_a, value * 1.05::DOUBLE AS pred_b, 60.0::DOUBLE + row_idx % 7 AS pred_c FROM s)"""


def show(df: DataFrame, ids: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Ids as they are, doubles rounded."""
    return df.select(*ids, *[rounded_to(v, digits).alias(v) for v in values])


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
