"""Overlap, leakage and duplicate checks between a test and a training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.asof import interp_join
from strataline.functions.series import ROW, attach
from strataline.operators.align import prepare_reference
from strataline.operators.datum import contact_predict
from strataline.operators.evaluate import metrics
from strataline.operators.gaps import interpolate_gaps

WELL = ("well_id",)


def _grid(xyz: Sequence[str], digits: int) -> list[Column]:
    return [F.rint(F.col(c) * 10**digits).cast("long").alias(f"_k{i}") for i, c in enumerate(xyz)]


def exact_coordinate_blend(
    test: DataFrame,
    train: DataFrame,
    pred: str,
    target: str,
    weight: float = 0.28,
    xyz: Sequence[str] = ("x", "y", "z"),
    first: Sequence[str] = (*WELL, ROW),
    digits: int = 2,
    out: str = "blended",
) -> DataFrame:
    """Mix in the training target found at the same rounded coordinates; of several, the first in order ``first``.

    Training rows collapse to one per place before the join, so that a place with many copies is one row.
    """
    places = [f"_k{i}" for i in range(len(xyz))]
    known = train.where(F.col(target).isNotNull()).select(*_grid(xyz, digits), F.col(target).alias("_t"), F.struct(*first).alias("_o"))
    lookup = known.groupBy(*places).agg(F.min_by("_t", "_o").alias("exact_value"))
    joined = test.select(*test.columns, *_grid(xyz, digits)).join(lookup, places, "left").drop(*places)
    mixed = (1 - weight) * F.col(pred) + weight * F.col("exact_value")
    return joined.withColumn(out, F.coalesce(mixed, pred))


def label_lookup(sample: DataFrame, truth: DataFrame, ids: Sequence[str], value: str, out: str = "label") -> DataFrame:
    """Training label of each sample id, NULL where there is none."""
    return sample.join(truth.select(*ids, F.col(value).alias(out)), list(ids), "left")


def lookup_complete(labels: DataFrame, out: str = "label") -> DataFrame:
    """Rows, missing labels, and whether none is missing."""
    missing = F.count(F.lit(1)) - F.count(out)
    return labels.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing"), (missing == 0).alias("complete"))


def _train_curve(train: DataFrame, cols: Sequence[str], md: str, keys: Sequence[str]) -> DataFrame:
    """Training columns by depth, equal depths averaged."""
    return train.where(F.col(md).isNotNull()).groupBy(*keys, md).agg(*[F.avg(c).alias(f"train_{c}") for c in cols])


# Limits of the same-entity check.
GATE_LIMITS = {"rows": 50, "target_rmse": 0.02, "log_gap": 0.50, "z_gap": 0.02}


def overlap_gate(
    test: DataFrame,
    train: DataFrame,
    limits: dict[str, float] | None = None,
    target: str = "tvt",
    probe: str = "tvt_input",
    log: str = "gr",
    z: str = "z",
    md: str = "md",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Whether a test entity is the training entity of the same id: z, log and known target agree by depth.

    One row per test entity: rows compared, mean absolute z and log gap, target RMSE, status, accepted.
    """
    keys = list(keys)
    allowed = GATE_LIMITS | (limits or {})
    filled = interpolate_gaps(train, log, "_log", keys=keys, row=row).withColumn(log, F.col("_log"))
    curve = _train_curve(filled, [z, log, target], md, keys)
    found = interp_join(test, curve, keys, md, md, {f"_{c}": f"train_{c}" for c in (z, log, target)}, edge="null")
    gap_z, gap_log = F.abs(F.col(z) - F.col(f"_{z}")), F.when(F.col(f"_{z}").isNotNull(), F.abs(F.col(log) - F.col(f"_{log}")))
    gap_t = F.col(probe) - F.col(f"_{target}")
    sums = found.groupBy(*keys).agg(
        F.count(gap_z).alias("z_rows"),
        F.count(gap_log).alias("log_rows"),
        F.count(gap_t).alias("known_rows"),
        F.avg(gap_z).alias("z_gap"),
        F.avg(gap_log).alias("log_gap"),
        F.sqrt(F.avg(gap_t * gap_t)).alias("target_rmse"),
    )
    copies = train.select(*keys).distinct().withColumn("_copy", F.lit(True))
    ok = (
        (F.col("target_rmse") < allowed["target_rmse"])
        & (F.col("log_gap") < allowed["log_gap"])
        & (F.col("z_gap") < allowed["z_gap"])
    )
    status = (
        F.when(F.col("_copy").isNull(), "no_copy")
        .when(F.col("z_rows") < allowed["rows"], "too_few_z_rows")
        .when(F.col("known_rows") < allowed["rows"], "too_few_known_rows")
        .when(F.coalesce(ok, F.lit(False)), "accepted")
        .otherwise("gate_failed")
    )
    return (
        sums.join(copies, keys, "left")
        .withColumn("status", status)
        .withColumn("accepted", F.col("status") == "accepted")
        .drop("_copy")
    )


def gated_override(
    test: DataFrame,
    train: DataFrame,
    gate: DataFrame,
    pred: str,
    weight: float = 0.5,
    target: str = "tvt",
    md: str = "md",
    out: str = "overridden",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Mix the training target (by depth, inside the training range) into accepted entities; flags changed rows."""
    keys = list(keys)
    curve = _train_curve(train, [target], md, keys)
    found = interp_join(test, curve, keys, md, md, {"_value": f"train_{target}"}, edge="null")
    joined = attach(found, gate.select(*keys, "accepted"), keys, row)
    use = F.coalesce("accepted", F.lit(False)) & F.col("_value").isNotNull()
    mixed = (1 - weight) * F.col(pred) + weight * F.col("_value")
    return joined.withColumns({out: F.when(use, mixed).otherwise(F.col(pred)), "changed": use}).drop("_value", "accepted")


def changed_report(df: DataFrame, keys: Sequence[str] = WELL) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("changed").cast("long")).alias("changed_rows"))


def contact_override(
    test: DataFrame,
    train: DataFrame,
    ref: DataFrame,
    label: str,
    surface: str,
    pred: str,
    limit: float = 1.0,
    min_rows: int = 50,
    min_train: int = 100,
    target: str = "tvt",
    probe: str = "tvt_input",
    md: str = "md",
    z: str = "z",
    out: str = "overridden",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Replace predictions by the contact-based target of the training copy where it explains the known prefix.

    The copy needs ``min_train`` usable rows, ``min_rows`` known test rows in its depth range and an
    RMSE of at most ``limit`` there; only rows in that range change.
    """
    keys = list(keys)
    physical = contact_predict(train, ref, label, surface, target, z, "tvt", "geology", "_phys", keys=keys, ref_keys=ref_keys, row=row)
    usable = physical.where(F.col("_phys").isNotNull() & F.col(md).isNotNull())
    curve = usable.groupBy(*keys, md).agg(F.avg("_phys").alias("_phys"))
    enough = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_rows"))
    found = interp_join(test, curve, keys, md, md, {"_value": "_phys"}, edge="null")
    miss = F.col("_value") - F.col(probe)
    gate = (
        found.groupBy(*keys)
        .agg(F.count(miss).alias("known_rows"), F.sqrt(F.avg(miss * miss)).alias("prefix_rmse"))
        .join(enough, keys, "left")
    )
    ok = (F.col("train_rows") >= min_train) & (F.col("known_rows") >= min_rows) & (F.col("prefix_rmse") <= limit)
    accepted = gate.select(*keys, F.coalesce(ok, F.lit(False)).alias("_ok"))
    joined = attach(found, accepted, keys, row)
    use = F.col("_ok") & F.col("_value").isNotNull()
    return joined.withColumns({out: F.when(use, F.col("_value")).otherwise(F.col(pred)), "changed": F.coalesce(use, F.lit(False))}).drop(
        "_value", "_ok"
    )


def exclude_entities(a: DataFrame, b: DataFrame, keys: Sequence[str] = WELL) -> DataFrame:
    """Rows of entities of ``a`` that ``b`` does not have."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def score_overlap(submission: DataFrame, truth: DataFrame, ids: Sequence[str], pred: str, value: str) -> DataFrame:
    """Scores of a submission on the ids with known truth, and how many ids have none."""
    joined = label_lookup(submission, truth, ids, value, "_truth")
    counts = joined.agg((F.count(F.lit(1)) - F.count("_truth")).alias("missing_truth"))
    return metrics(joined, "_truth", pred).crossJoin(counts)  # one row each
