"""Blending and tuning of prediction columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.columns import array_std, clip, total
from strataline.functions.gram import Gram, gram, gram_by, gram_sums
from strataline.functions.quantiles import add_overall
from strataline.functions.series import ROW, with_key_stats
from strataline.operators import search
from strataline.operators.smooth import fade, median_cascade, savgol

WELL = ("well_id",)


def blend(df: DataFrame, weights: dict[str, float], out: str = "blend") -> DataFrame:
    """Weighted sum of prediction columns."""
    return df.withColumn(out, total([F.col(c) * F.lit(float(w)) for c, w in weights.items()]))


def blend_mean(df: DataFrame, cols: Sequence[str], out: str = "blend") -> DataFrame:
    """Plain mean over seeds or folds."""
    return blend(df, {c: 1.0 / len(cols) for c in cols}, out)


def rank_blend(
    df: DataFrame, weights: dict[str, float], corrections: Sequence[float], mix: tuple[float, float], out: str = "rank_blend"
) -> DataFrame:
    """Weight = main weight + correction by the column's rank in its row; ``mix`` weighs ascending and descending rank.

    Equal values keep the order of the columns in both directions.
    """
    fixed = F.array(*[F.lit(float(c)) for c in corrections])
    items = list(weights.items())

    def one(descending: bool) -> Column:
        sign = -1.0 if descending else 1.0
        entries = F.array(
            *[
                F.struct((F.col(c) * sign).alias("key"), F.lit(i).alias("at"), F.col(c).cast("double").alias("v"), F.lit(float(w)).alias("w"))
                for i, (c, w) in enumerate(items)
            ]
        )
        parts = F.transform(F.array_sort(entries), lambda e, r: e["v"] * (e["w"] + F.get(fixed, r)))
        return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)

    return df.withColumn(out, mix[0] * one(False) + mix[1] * one(True))


def _weights_table(df: DataFrame, names: Sequence[str], weights: Sequence[float], score: float, **extra: float) -> DataFrame:
    rows = [(n, float(w), float(score), *[float(v) for v in extra.values()]) for n, w in zip(names, weights)]
    return df.sparkSession.createDataFrame(
        rows, ", ".join(["model string, weight double, rmse double", *[f"{k} double" for k in extra]])
    )


def hill_climb_average(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    weights, score = search.greedy_average(gram(df, cols, y))
    return _weights_table(df, cols, weights, score)


def hill_climb_transfer(df: DataFrame, cols: Sequence[str], y: str, step: float = 0.01, negative: bool = False) -> DataFrame:
    weights, score = search.transfer_climb(gram(df, cols, y), step, negative)
    return _weights_table(df, cols, weights, score)


def greedy_blend(df: DataFrame, cols: Sequence[str], y: str, precision: float = 0.01, negative: bool = False) -> DataFrame:
    count = round(0.5 / precision)
    grid = [i * precision for i in range(-count if negative else 1, count + 1)]
    weights, score = search.greedy_convex(gram(df, cols, y), grid)
    return _weights_table(df, cols, weights, score)


def simplex_grid(df: DataFrame, cols: Sequence[str], y: str, step: float = 0.05) -> DataFrame:
    """Error of every convex combination of the three best models on a grid, from one aggregate of the rows."""
    sums = gram(df, cols, y)
    top, count = search.best_three(sums), round(1 / step)
    spark = df.sparkSession
    grid = spark.range(count + 1).select(F.col("id").alias("i")).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count) - F.col("i")))
    )
    shares = [F.col("i") / count, F.col("j") / count, (F.lit(count) - F.col("i") - F.col("j")) / count]
    size = len(cols)
    vector = {p: s for p, s in zip(top, shares)} | {size: F.lit(-1.0)}
    square = total([vector[a] * vector[b] * F.lit(float(sums.sums[a, b])) for a in vector for b in vector])
    return grid.select(
        *[s.alias(f"w{n + 1}") for n, s in enumerate(shares)],
        F.sqrt(F.greatest(square / sums.rows, F.lit(0.0))).alias("rmse"),
    )


def nnls_stack(
    df: DataFrame, cols: Sequence[str], y: str, fold: str | None = None, intercept: bool = False, normalize: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Non-negative weights; per fold they are fitted on the other folds. Returns (weights, rows with ``oof``)."""
    return _stack(df, cols, y, fold, lambda g: search.nnls(g, intercept), normalize)


def ridge_stack(df: DataFrame, cols: Sequence[str], y: str, alpha: float = 1.0, fold: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Non-negative ridge with intercept; per fold on the other folds. Returns (weights, rows with ``oof``)."""
    return _stack(df, cols, y, fold, lambda g: search.ridge_positive(g, alpha), False)


def _stack(df, cols, y, fold, fit, normalize) -> tuple[DataFrame, DataFrame]:
    parts = gram_by(df, cols, y, fold) if fold else {None: gram(df, cols, y)}
    whole = reduce(lambda a, b: a + b, parts.values())
    rows, value = [], None
    for name, part in sorted(parts.items(), key=lambda p: str(p[0])):
        weights, constant = fit(whole - part if fold else part)
        if normalize:
            size = sum(weights) + 1e-12
            weights = [w / size for w in weights]
        formula = total([F.col(c) * F.lit(w) for c, w in zip(cols, weights)]) + F.lit(constant)
        if fold:
            value = F.when(F.col(fold) == name, formula) if value is None else value.when(F.col(fold) == name, formula)
        else:
            value = formula
        rows += [(None if name is None else int(name), c, float(w), float(constant)) for c, w in zip(cols, weights)]
    table = df.sparkSession.createDataFrame(rows, "fold int, model string, weight double, intercept double")
    return table, df.withColumn("oof", value)


def convex_weights(
    df: DataFrame, cols: Sequence[str], y: str, pull: float = 0.0, weighting: str = "rows", *, keys: Sequence[str] = WELL
) -> DataFrame:
    """Convex weights with a pull towards equal ones; rows or entities count the same.

    With ``entities`` each row weighs one over its entity's rows: sums per entity first, divided there.
    """
    if weighting == "entities":
        names = [f"s_{i}_{j}" for i in range(len(cols) + 2) for j in range(i, len(cols) + 2)]
        per_key = gram_sums(df, cols, y, list(keys))
        size = F.col(f"s_{len(cols) + 1}_{len(cols) + 1}")
        found = Gram.of(cols, per_key.agg(*[F.sum(F.col(n) / size).alias(n) for n in names]).first())
    else:
        found = gram(df, cols, y)
    weights = search.convex(found, pull)
    return _weights_table(df, cols, weights, found.rmse(weights))


def weight_grid(
    df: DataFrame, base: str, a: str, b: str, y: str, grid_a: Sequence[float], grid_b: Sequence[float]
) -> DataFrame:
    """RMSE of ``base + u·a + v·b`` for every pair of weights, from one aggregate of the rows with all four known; the best first."""
    r, x, z = F.col(y) - F.col(base), F.col(a), F.col(b)
    sums = df.where(r.isNotNull() & x.isNotNull() & z.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(r * r).alias("rr"), F.sum(r * x).alias("ra"), F.sum(r * z).alias("rb"),
        F.sum(x * x).alias("aa"), F.sum(x * z).alias("ab"), F.sum(z * z).alias("bb"),
    )
    grid = sums.withColumn("u", F.explode(F.array(*[F.lit(float(v)) for v in grid_a]))).withColumn(
        "v", F.explode(F.array(*[F.lit(float(v)) for v in grid_b]))
    )
    u, v = F.col("u"), F.col("v")
    sse = F.col("rr") - 2 * u * F.col("ra") - 2 * v * F.col("rb") + u * u * F.col("aa") + 2 * u * v * F.col("ab") + v * v * F.col("bb")
    return grid.select(u.alias("weight_a"), v.alias("weight_b"), F.sqrt(F.greatest(sse / F.col("n"), F.lit(0.0))).alias("rmse")).orderBy(
        "rmse", "weight_a", "weight_b"
    )


def _fade_sums(df: DataFrame, target: str, cols: Sequence[str], md_since: str, taus: Sequence[float | None]) -> DataFrame:
    """One row per τ with product sums of the target and the faded columns; all τ in one pass over the rows with all of them known."""
    t = F.col(target)
    for c in (target, md_since, *cols):
        df = df.where(F.col(c).isNotNull())
    aggregates = [F.count(t).alias("n"), F.sum(t * t).alias("tt")]
    for i, tau in enumerate(taus):
        faded = [F.col(c) * fade(md_since, tau) for c in cols]
        aggregates += [F.sum(t * f).alias(f"t{a}_{i}") for a, f in enumerate(faded)]
        aggregates += [F.sum(faded[a] * faded[b]).alias(f"p{a}{b}_{i}") for a in range(len(cols)) for b in range(a, len(cols))]
    wide = df.agg(*aggregates)
    fields = [f"t{a}" for a in range(len(cols))] + [f"p{a}{b}" for a in range(len(cols)) for b in range(a, len(cols))]
    rows = F.array(
        *[
            F.struct(F.lit(tau).cast("double").alias("tau"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
            for i, tau in enumerate(taus)
        ]
    )
    return wide.select("n", "tt", F.explode(rows).alias("_r")).select("n", "tt", "_r.*")


def policy_grid(
    df: DataFrame,
    target: str,
    model: str,
    tracker: str,
    md_since: str,
    alphas: Sequence[float],
    taus: Sequence[float | None],
    weights: Sequence[float],
) -> DataFrame:
    """RMSE of ``α·fade·((1 − w)·model + w·tracker)`` for every α, τ, w; rows are read once."""
    sums = _fade_sums(df, target, [model, tracker], md_since, taus)
    grid = sums.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))).withColumn(
        "weight", F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    )
    a, w = F.col("alpha"), F.col("weight")
    cross = (1 - w) * F.col("t0") + w * F.col("t1")
    square = (1 - w) * (1 - w) * F.col("p00") + 2 * w * (1 - w) * F.col("p01") + w * w * F.col("p11")
    sse = F.col("tt") - 2 * a * cross + a * a * square
    return grid.select("alpha", "tau", "weight", F.sqrt(F.greatest(sse / F.col("n"), F.lit(0.0))).alias("rmse"))


def fit_alpha(
    df: DataFrame, target: str, delta: str, md_since: str, taus: Sequence[float | None], bounds: tuple[float, float] = (0.0, 1.5)
) -> DataFrame:
    """Best scale of the faded delta per τ, ``Σ y·d / Σ d²``, kept within bounds, with its RMSE."""
    sums = _fade_sums(df, target, [delta], md_since, taus)
    raw = F.when(F.col("p00") <= 1e-12, 0.0).otherwise(F.col("t0") / F.col("p00"))
    scaled = sums.withColumn("alpha", clip(raw, *bounds))
    a = F.col("alpha")
    sse = F.col("tt") - 2 * a * F.col("t0") + a * a * F.col("p00")
    return scaled.select("tau", "alpha", F.sqrt(F.greatest(sse / F.col("n"), F.lit(0.0))).alias("rmse"))


def sweep(
    df: DataFrame, pred: str, y: str, candidates: Sequence[dict], epsilon: float = 0.002, *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Scores smoother candidates; keeps the unsmoothed prediction unless the best gains more than ε.

    A candidate: ``name``, ``kind`` (none, savgol, median, median_savgol), ``window``, ``order``, ``median``, ``shrink``.
    Each distinct smoother runs once, however many shrink shares use it, and all are scored in one aggregate.
    """
    smoothers: dict[tuple, str] = {}
    rows, errors = df, []
    for c in candidates:
        kind = c["kind"]
        if kind == "none":
            errors.append((c["name"], F.col(pred)))
            continue
        made = (kind, c.get("window"), c.get("order"), c.get("median"))
        if made not in smoothers:
            smoothers[made] = name = f"_smooth{len(smoothers)}"
            if kind == "savgol":
                rows = savgol(rows, pred, c["window"], c["order"], name, keys=keys, row=row)
            elif kind == "median":
                rows = median_cascade(rows, pred, c["window"], out=name, keys=keys, row=row)
            elif kind == "median_savgol":
                rows = median_cascade(rows, pred, c["median"], c["window"], c["order"], name, keys=keys, row=row)
            else:
                raise ValueError(kind)
        smooth = F.col(smoothers[made])
        errors.append((c["name"], F.col(pred) + float(c.get("shrink", 1.0)) * (smooth - F.col(pred))))
    scores = rows.agg(*[F.sqrt(F.avg(F.pow(F.col(y) - v, 2))).alias(f"r{i}") for i, (_, v) in enumerate(errors)])
    table = scores.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(f"r{i}").alias("rmse")) for i, (n, _) in enumerate(errors)])
        ).alias("_c"),
        F.least(*[F.col(f"r{i}") for i in range(len(errors))]).alias("_best") if len(errors) > 1 else F.col("r0").alias("_best"),
        F.col(f"r{[n for n, _ in errors].index('none')}").alias("_base"),
    ).select("_c.*", "_best", "_base")
    keep_base = F.col("_best") >= F.col("_base") - epsilon
    chosen = F.when(keep_base, F.col("name") == "none").otherwise(F.col("rmse") == F.col("_best"))
    return table.select("position", "name", "rmse", chosen.alias("chosen")).orderBy("rmse", "position")


def regime_code(
    df: DataFrame,
    length_limit: float,
    span_limits: Sequence[float],
    variants: dict[int, str],
    default: str,
    probe: str = "tvt_input",
    z: str = "z",
    *,
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Regime of each series from the length and the vertical span of its tail, and the variant for it."""
    tail_z = F.when(F.col(probe).isNull(), F.col(z))
    found = df.groupBy(*keys).agg(
        (F.count(F.lit(1)) - F.count(probe)).alias("eval_len"),
        F.coalesce(F.max(tail_z) - F.min(tail_z), F.lit(0.0)).alias("z_span"),
    )
    bins = total([(F.col("z_span") >= float(s)).cast("int") for s in span_limits])
    code = (F.col("eval_len") > length_limit).cast("int") + 2 * bins
    names = F.create_map(*[F.lit(v) for pair in variants.items() for v in pair])
    return found.withColumn("regime", code).withColumn("variant", F.coalesce(F.try_element_at(names, F.col("regime")), F.lit(default)))


def _number_after(variant: str, word: str) -> Column:
    text = F.regexp_extract(F.col(variant), f"(?:^|_){word}_([0-9.]+)", 1)
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def apply_variant(
    df: DataFrame, variant: str, bases: dict[str, str], fallback: str, second: str, hold: str, out: str = "variant_pred"
) -> DataFrame:
    """Prediction named by a variant such as ``pf_scale_5_beam_0.1_hold_0.2``.

    The scale picks the base column, ``beam`` mixes in the second signal, ``hold`` the held value.
    """
    scale = F.regexp_extract(F.col(variant), "scale_([0-9.]+)", 1)
    base = F.col(fallback)
    for name, column in bases.items():
        base = F.when(scale.try_cast("double") == float(name), F.col(column)).otherwise(base)
    beam, keep = _number_after(variant, "beam"), _number_after(variant, "hold")
    mixed = (1 - beam) * base + beam * F.col(second)
    return df.withColumn(out, (1 - keep) * mixed + keep * F.col(hold))


def blend_from_history(df: DataFrame, history: DataFrame, cols: Sequence[str], ids: Sequence[str], out: str = "blend") -> DataFrame:
    """Apply saved weights ``(model, weight)``; models without a weight and unknown predictions do not count.

    The weights of the named columns are one row next to every row; a row with nothing to weigh gets NULL.
    """
    weights = history.agg(*[F.sum(F.when(F.col("model") == c, F.col("weight"))).alias(f"_w_{i}") for i, c in enumerate(cols)])
    parts = F.filter(F.array(*[F.col(c).cast("double") * F.col(f"_w_{i}") for i, c in enumerate(cols)]), lambda p: p.isNotNull())
    value = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a + p))
    return add_overall(df, weights).select(*ids, value.alias(out))


def entity_features(df: DataFrame, cols: Sequence[str], core: Sequence[str], keys: Sequence[str] = WELL) -> DataFrame:
    """Mean of every column, std of the core columns and row count per entity; unknown values become 0."""
    zero = F.lit(0.0)
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.avg(c), zero).alias(f"{c}__mean") for c in cols],
        *[F.coalesce(F.stddev_samp(c), zero).alias(f"{c}__std") for c in core],
        F.count(F.lit(1)).alias("row_count"),
    )


def ensemble_features(
    df: DataFrame, members: Sequence[str], families: dict[str, Sequence[str]], base: str, *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Disagreement of the members: std, range, family means and their difference, base centred by entity, place."""
    every = F.array(*[F.col(m).cast("double") for m in members])
    means = {f"{name}_mean": total([F.col(m) for m in group]) / float(len(group)) for name, group in families.items()}
    names = list(means)
    rows = with_key_stats(df, keys, {"_mean": F.avg(base), "_n": F.count(F.lit(1)), "_first": F.min(row)}, row).withColumns(means)
    out = {
        "member_std": array_std(every),
        "member_range": F.array_max(every) - F.array_min(every),
        "base_centered": F.col(base) - F.col("_mean"),
        "row_frac": (F.col(row) - F.col("_first")) / F.greatest(F.col("_n") - 1, F.lit(1)),
        "log_rows": F.log1p("_n"),
    }
    if len(names) == 2:
        out["family_difference"] = F.col(names[0]) - F.col(names[1])
    return rows.withColumns(out).drop("_mean", "_n", "_first")


def known_row_blend(
    df: DataFrame,
    models: Sequence[str],
    mode: str = "softmax",
    n: int = 50,
    temperature: float = 1.0,
    margin: float = 0.0,
    probe: str = "tvt_input",
    out: str = "blend",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Per-entity weights from each model's error on the last n known rows.

    ``choose``: the best, or the average of the best two when they are within ``margin``;
    ``softmax``: exp(−(e − least)/temperature); ``rank``: 1/(1 + rank). Also ``choice``, the model with most weight.
    """
    known = F.col(probe).isNotNull()
    rows = with_key_stats(df, keys, {"_end": F.max(F.when(known, F.col(row)))}, row)
    late = known & (F.col(row) > F.col("_end") - n)
    errors = {f"_e_{m}": F.avg(F.when(late, F.pow(F.col(probe) - F.col(m), 2))) for m in models}
    rows = with_key_stats(rows, keys, errors, row)
    scores = F.array_sort(
        F.array(*[F.struct(F.coalesce(F.sqrt(f"_e_{m}"), F.lit(0.0)).alias("e"), F.lit(i).alias("i"), F.col(m).cast("double").alias("p"), F.lit(m).alias("m")) for i, m in enumerate(models)])
    )
    rows = rows.withColumn("_s", scores)
    first, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    if mode == "choose":
        close = second["e"] - first["e"] < margin
        value = F.when(close, (first["p"] + second["p"]) / 2).otherwise(first["p"])
        choice = F.when(close & (second["i"] < first["i"]), second["m"]).otherwise(first["m"])
    else:
        if mode == "softmax":
            weights = F.transform("_s", lambda s: F.exp(-(s["e"] - first["e"]) / max(temperature, 1e-6)))
        elif mode == "rank":
            weights = F.transform("_s", lambda s, r: 1.0 / (1.0 + r))
        else:
            raise ValueError(mode)
        sums = F.aggregate(F.zip_with("_s", weights, lambda s, w: s["p"] * w), F.lit(0.0), lambda a, v: a + v)
        value = sums / F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
        choice = first["m"]
    return rows.withColumns({out: value, "choice": choice}).drop("_end", "_s", *errors)


def choice_counts(df: DataFrame, keys: Sequence[str] = WELL) -> DataFrame:
    """How many entities chose each model."""
    return df.groupBy(*keys).agg(F.min("choice").alias("choice")).groupBy("choice").agg(F.count(F.lit(1)).alias("entities"))


def confidence_gate(
    df: DataFrame, formula: str, error: str, distance: str, other: str | None = None, out: str = "gate"
) -> DataFrame:
    """Row weight 0–0.55 from prefix error, neighbour distance and disagreement; 0 without a formula value."""
    error_part = 1.0 / (1.0 + F.pow(F.coalesce(error, F.lit(25.0)) / 8.0, 2))
    distance_part = 1.0 / (1.0 + F.pow(F.coalesce(distance, F.lit(2.0)) / 1.2, 2))
    gate = 0.05 + 0.55 * error_part * distance_part
    if other is not None:
        gate = gate * clip((35.0 - F.abs(F.col(formula) - F.col(other))) / 25.0, 0.0, 1.0)
    return df.withColumn(out, F.when(F.col(formula).isNull(), 0.0).otherwise(clip(gate, 0.0, 0.55)))
