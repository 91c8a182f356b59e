"""One answer end to end: how far off are two simple predictions of each series' tail?"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.evaluate import stage_report
from strataline.operators.smooth import trend_baseline
from strataline.operators.zones import prefix_linear_fit
from strataline.plans.fixtures import KEYS, SERIES, series, show
from strataline.plans.registry import query
from strataline.plans.zones import ANCHOR


def holdout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold out the last 30 % of each series; error of the last value, of the recent trend and of the prefix line."""
    rows = trend_baseline(series(spark, sf_dir), "constant", out="constant", keys=KEYS)
    rows = trend_baseline(rows, "linear", out="trend", keys=KEYS)
    rows = prefix_linear_fit(rows, keys=KEYS).withColumnRenamed("extrapolated", "line")
    report = stage_report(rows.where(F.col("tvt_input").isNull()), "value", ["constant", "trend", "line"])
    return show(report, ["position", "stage", "rows"], ["rmse", "gain"])


query(
    "z01_holdout_report",
    f"""WITH {SERIES}, {ANCHOR}, g AS (SELECT *, (value - lag(value) OVER w) / nullif(md - lag(md) OVER w, 0) AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)),
        h AS (SELECT user_id, least(greatest(quantile_cont(d, 0.5), -0.12), 0.12) AS r FROM g WHERE NOT is_eval AND row_idx > eval_start - 30 GROUP BY 1),
        f AS (SELECT user_id, regr_slope(value, md) AS b, regr_intercept(value, md) AS a FROM s WHERE NOT is_eval GROUP BY 1),
        t AS (SELECT count(*) AS rows, sqrt(avg(pow(value - av, 2))) AS c, sqrt(avg(pow(value - av - r * (md - amd), 2))) AS t, sqrt(avg(pow(value - a - b * md, 2))) AS l
          FROM s JOIN k USING (user_id) JOIN h USING (user_id) JOIN f USING (user_id) WHERE is_eval)
        SELECT position, stage, rows, round([c, t, l][position + 1], 6) + 0.0 AS rmse, round(c - [c, t, l][position + 1], 6) + 0.0 AS gain FROM t, (VALUES (0, 'constant'), (1, 'trend'), (2, 'line')) v(position, stage)""",
)(holdout_report)
