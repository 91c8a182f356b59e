"""The same-entity gate of the N3 and N4 queries takes series of 20 known rows or more."""

from datetime import datetime, timedelta

from strataline.plans.catalog import CATALOG


def test_gate_of_the_queries_takes_short_series(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [
        (user * 1000 + i, start + timedelta(hours=i), user, "view", 50.0 + (i * 7 + user) % 13)
        for user, size in ((10, 40), (20, 20), (30, 100))
        for i in range(size)
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    gate = {r.user_id: r for r in CATALOG["n03_overlap_gate"].plan(spark, str(tmp_path)).collect()}
    assert {u: r.status for u, r in gate.items()} == {10: "accepted", 20: "too_few_known_rows", 30: "accepted"}
    assert gate[10].known_rows == 28
    report = {r.user_id: (r.rows, r.changed_rows) for r in CATALOG["n04_changed_report"].plan(spark, str(tmp_path)).collect()}
    assert report == {10: (40, 40), 20: (20, 0), 30: (100, 100)}
    changed = {r.user_id for r in CATALOG["n04_gated_override"].plan(spark, str(tmp_path)).where("changed").collect()}
    assert changed == {10, 30}
