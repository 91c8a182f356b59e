"""Prediction tables: alignment with a sample, audit, comparison of candidates, experiment log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.quantiles import add_overall, key_percentiles, overall

LOG_SCHEMA = (
    "experiment_id string, timestamp string, phase string, model string, cv_rmse double, cv_rmse_std double, "
    "n_features int, base_experiment string, description string, notes string, oof_path string, test_path string, "
    "training_time_seconds double"
)


def align_to_sample(pred: DataFrame, sample: DataFrame, value: str, fallback: float | DataFrame, id_col: str = "id") -> DataFrame:
    """Exactly the sample's ids; missing predictions take a constant, or the single value of a one-row table."""
    joined = sample.select(id_col).join(pred.select(id_col, value), id_col, "left")
    if isinstance(fallback, DataFrame):
        name = fallback.columns[0]
        return add_overall(joined, fallback.select(F.col(name).alias("_fill"))).withColumn(value, F.coalesce(value, "_fill")).drop("_fill")
    return joined.withColumn(value, F.coalesce(value, F.lit(float(fallback))))


def dedupe_mean(pred: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """Several predictions of an id become their mean."""
    return pred.groupBy(id_col).agg(F.avg(value).alias(value))


def _is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def submission_audit(pred: DataFrame, sample: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """Rows, duplicates, ids missing or unknown, non-finite values, and their range: one row."""
    per_id = pred.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((~_is_finite(F.col(value))).cast("long")).alias("_bad"),
        F.sum(F.when(_is_finite(F.col(value)), F.col(value))).alias("_s"),
        F.sum(F.when(_is_finite(F.col(value)), F.col(value) * F.col(value))).alias("_ss"),
        F.min(F.when(_is_finite(F.col(value)), F.col(value))).alias("_lo"),
        F.max(F.when(_is_finite(F.col(value)), F.col(value))).alias("_hi"),
    )
    wanted = sample.select(id_col).distinct().withColumn("_in", F.lit(True))
    zero = F.lit(0).cast("long")
    both = per_id.join(wanted, id_col, "full")
    report = both.agg(
        F.sum(F.coalesce("_n", zero)).alias("rows"),
        F.count("_in").alias("sample_rows"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(zero)).alias("duplicates"),
        F.sum(F.col("_n").isNull().cast("long")).alias("missing_ids"),
        F.sum(F.col("_in").isNull().cast("long")).alias("unknown_ids"),
        F.sum(F.coalesce("_bad", zero)).alias("non_finite"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
        F.sum("_s").alias("_s"),
        F.sum("_ss").alias("_ss"),
    )
    good = F.col("rows") - F.col("non_finite")
    mean = F.col("_s") / good
    clean = (F.col("duplicates") + F.col("missing_ids") + F.col("unknown_ids") + F.col("non_finite")) == 0
    return report.withColumns(
        {"mean": mean, "std": F.sqrt(F.greatest(F.col("_ss") / good - mean * mean, F.lit(0.0))), "valid": clean}
    ).drop("_s", "_ss")


def _row_number_hash(id_col: str, value: str, digits: int) -> Column:
    v = F.col(value).cast("double")
    scaled = F.rint(v * 10**digits)
    # Within the grid the scaled whole number; beyond it, NaN, infinity and unknown each have a form of their own.
    form = (
        F.when(v.isNull(), "null")
        .when(F.isnan(v), "nan")
        .when(F.abs(scaled) < 9e18, scaled.try_cast("bigint").cast("string"))
        .otherwise(v.cast("string"))
    )
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), form))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def content_hash(df: DataFrame, value: str, by: Sequence[str] = (), id_col: str = "id", digits: int = 6) -> DataFrame:
    """Fingerprint of the (id, value) pairs that does not depend on their order or partitioning.

    A sum of per-row hashes of the value on a grid of ``digits`` decimals; equal tables have equal sums.
    """
    total = F.sum(_row_number_hash(id_col, value, digits)).cast("string").alias("fingerprint")
    counts = F.count(F.lit(1)).alias("rows")
    return df.groupBy(*by).agg(counts, total) if by else df.agg(counts, total)


def candidate_stats(
    preds: DataFrame, sample: DataFrame, name: str = "name", value: str = "value", id_col: str = "id"
) -> DataFrame:
    """Mean, std, range and percentiles of each candidate, and whether it covers the sample exactly with finite values."""
    wanted = sample.select(id_col).distinct().withColumn("_in", F.lit(True))
    size = wanted.agg(F.count(F.lit(1)).alias("_size"))
    marked = preds.join(wanted, id_col, "left")
    stats = marked.groupBy(name).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count("_in").alias("_known"),
        F.sum(_is_finite(F.col(value)).cast("long")).alias("_finite"),
    )
    shares = key_percentiles(preds, [name], {"q01": (value, 0.01), "q50": (value, 0.5), "q99": (value, 0.99)})
    whole = add_overall(stats.join(shares, name), size)
    valid = (F.col("rows") == F.col("_size")) & (F.col("_known") == F.col("rows")) & (F.col("_finite") == F.col("rows"))
    return whole.withColumn("valid", valid).drop("_known", "_finite", "_size")


def pairwise_distance(preds: DataFrame, names: Sequence[str], name: str = "name", value: str = "value", id_col: str = "id") -> DataFrame:
    """RMSE and summed absolute difference of every pair of candidates, over the ids both have.

    Candidates become columns (a handful of names), blocks of ids are compared as matrices, and every
    task hands over one row per pair; pairs of rows never exist.
    """
    ordered = sorted(names)
    pairs = np.array(list(combinations(range(len(ordered)), 2)), np.int32).reshape(-1, 2)
    wide = preds.groupBy(id_col).pivot(name, ordered).agg(F.avg(value)).select(*[F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(ordered)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(ordered), len(ordered)))
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for i in range(len(ordered)):
                gap = rows - rows[:, i : i + 1]
                known = ~np.isnan(gap)
                gap[~known] = 0.0
                total[:, i] += known.sum(axis=0), np.einsum("ij,ij->j", gap, gap), np.abs(gap).sum(axis=0)
        a, b = pairs.T
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(total[0][a, b].astype(np.int64)), pa.array(total[1][a, b]), pa.array(total[2][a, b])], names=["a", "b", "n", "s", "t"]
        )

    parts = wide.mapInArrow(sums, "a int, b int, n long, s double, t double")
    title = F.array(*[F.lit(n) for n in ordered])
    rows = F.sum("n")
    return (
        parts.groupBy("a", "b")
        .agg(rows.alias("rows"), F.when(rows > 0, F.sqrt(F.sum("s") / rows)).alias("rmse"), F.when(rows > 0, F.sum("t")).alias("abs_sum"))
        .select(F.get(title, F.col("a")).alias("left"), F.get(title, F.col("b")).alias("right"), "rows", "rmse", "abs_sum")
    )


def nearest_candidate(distances: DataFrame, fingerprints: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Nearest other candidate of each; with fingerprints, the nearest whose content differs.

    Distances that agree to nine decimals are equal; the name decides.
    """
    both = distances.select(F.col("left").alias(name), F.col("right").alias("other"), "rmse").unionByName(
        distances.select(F.col("right").alias(name), F.col("left").alias("other"), "rmse")
    )
    if fingerprints is not None:
        own = fingerprints.select(name, F.col("fingerprint").alias("_own"))
        theirs = fingerprints.select(F.col(name).alias("other"), F.col("fingerprint").alias("_their"))
        both = both.join(own, name).join(theirs, "other").where(F.col("_own") != F.col("_their"))
    return both.groupBy(name).agg(
        F.min_by("other", F.struct(F.round("rmse", 9), F.col("other"))).alias("nearest"), F.min("rmse").alias("nearest_rmse")
    )


def diversity_report(
    nearest: DataFrame, nearest_distinct: DataFrame, near: float = 0.02, far: float = 1.0, name: str = "name"
) -> DataFrame:
    """Candidates with a near duplicate, and candidates far from any other content, most distant first."""
    other = nearest_distinct.select(name, F.col("nearest").alias("distinct_nearest"), F.col("nearest_rmse").alias("distinct_rmse"))
    joined = nearest.join(other, name, "left")
    return joined.withColumns(
        {"near_duplicate": F.col("nearest_rmse") < near, "diverse": F.coalesce(F.col("distinct_rmse") >= far, F.lit(False))}
    ).orderBy(F.desc_nulls_last("distinct_rmse"), name)


def log_experiment(spark: SparkSession, records: Sequence[dict] | DataFrame, path: str) -> None:
    """Append result records to the experiment log (a folder of CSV files)."""
    fields = [f.split() for f in LOG_SCHEMA.split(", ")]
    names = [n for n, _ in fields]
    if isinstance(records, DataFrame):
        table = records.select(*[(F.col(n) if n in records.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    else:
        table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], LOG_SCHEMA)
    table.withColumns({"cv_rmse": F.round("cv_rmse", 4), "cv_rmse_std": F.round("cv_rmse_std", 4)}).write.mode("append").csv(path, header=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LOG_SCHEMA)


def best_experiments(log: DataFrame, n: int = 10, phase: str | None = None) -> DataFrame:
    """The n best scores, optionally of one phase; rows without a score do not count."""
    rows = log.where(F.col("cv_rmse").isNotNull())
    if phase is not None:
        rows = rows.where(F.col("phase") == phase)
    return rows.orderBy("cv_rmse", "experiment_id").limit(n)


def rank_counts(df: DataFrame, cols: Sequence[str], descending: bool = True) -> DataFrame:
    """How often each model is first, second, … across rows; equal values keep the order of the columns."""
    sign = -1.0 if descending else 1.0
    entries = F.array(*[F.struct((F.col(c) * sign).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("model")) for i, c in enumerate(cols)])
    return (
        df.select(F.posexplode(F.array_sort(entries)).alias("place", "e"))
        .groupBy(F.col("e.model").alias("model"), (F.col("place") + 1).alias("place"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def weight_ladder(a: DataFrame, b: DataFrame, weights: Sequence[float], value: str = "value", id_col: str = "id") -> DataFrame:
    """Blends of two prediction tables at several weights: mean, std, RMSE and 95th percentile of change against ``a``.

    The id sets must be equal. The change is the weight times one difference column, so that rows are not multiplied.
    """
    left, right = a.select(id_col, F.col(value).alias("_a")), b.select(id_col, F.col(value).alias("_b"))
    joined = left.join(right, id_col, "full").withColumn("_gap", F.col("_b") - F.col("_a"))
    sums = joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count("_gap").alias("_both"), F.avg("_a").alias("_ma"), F.avg("_b").alias("_mb"),
        F.var_samp("_a").alias("_va"), F.var_samp("_b").alias("_vb"), F.covar_samp("_a", "_b").alias("_cab"),
        F.sqrt(F.avg(F.col("_gap") * F.col("_gap"))).alias("_rmse"),
    )
    one = add_overall(sums, overall(joined, {"_p95": (F.abs(F.col("_gap")), 0.95)}))
    checked = one.withColumn("_ok", F.when(F.col("rows") == F.col("_both"), True).otherwise(F.raise_error(F.lit("id sets differ"))))
    ladder = checked.where("_ok").withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    w = F.col("weight")
    variance = w * w * F.col("_va") + (1 - w) * (1 - w) * F.col("_vb") + 2 * w * (1 - w) * F.col("_cab")
    return ladder.select(
        "weight",
        "rows",
        (w * F.col("_ma") + (1 - w) * F.col("_mb")).alias("mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
        ((1 - w) * F.col("_rmse")).alias("rmse_change"),
        ((1 - w) * F.col("_p95")).alias("p95_change"),
    )
