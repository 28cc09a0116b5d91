"""Quartile tiers and dossiers on streams against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.operators.quantiles import quantiles
from prioscope.operators.statistics import QUARTILES
from prioscope.sources.composed import composed_tickets
from prioscope.streaming import live, tiers

SCHEMA = "ticket_id int, channel string, resolution_minutes double, at timestamp"


def arrivals(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("group", [None, "channel"])
def test_tiers_follow_the_rows_so_far(spark, tmp_path, group):
    draw = np.random.default_rng(3)
    rows = [(i, ["Chat", "Mail", None][i % 3], None if i % 11 == 0 else float(np.round(draw.gamma(2, 40), 1)), None) for i in range(600)]
    folder = str(tmp_path / "in")
    seen = []
    for step in range(2):       # the second start continues from the checkpoint
        own = [rows[step * 300:step * 300 + 150], rows[step * 300 + 150:step * 300 + 300]]
        arrivals(spark, folder, own)
        stream = live.ticket_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        tiers.tier_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), group=group).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.ticket_id for r in out) == list(range(600))
    for number in range(4):
        batch = [r for r in out if r.batch == number]
        seen += [r.ticket_id for r in batch]
        for name in ("Chat", "Mail", None) if group else ("all",):
            known = spark.createDataFrame([rows[i] for i in seen if not group or rows[i][1] == name], SCHEMA)
            cuts = quantiles(known, {p: ("resolution_minutes", s) for p, s in QUARTILES.items()})
            for r in batch:
                if not group or r.channel == name:
                    assert (r.p25, r.p50, r.p75) == pytest.approx((cuts["p25"], cuts["p50"], cuts["p75"]), rel=1e-12)
                    m = r.resolution_minutes
                    assert r.resolution_tier == ("Unknown" if m is None else "Critical" if m > r.p75 else "High" if m > r.p50
                                                 else "Medium" if m > r.p25 else "Low")


def test_groups_expire(spark):
    empty = spark.createDataFrame([], "part string, sketch binary, total bigint, seen timestamp")
    day = lambda n: f"2024-01-{n:02} 00:00:00"
    rows = spark.createDataFrame([(1, "old", 5.0, day(1)), (2, "new", 7.0, day(9)), (3, "new", None, day(9))],
                                 "i int, g string, m double, at string")
    kept = tiers.merged_sketches(empty, rows, "m", F.col("g"), F.col("at"), "3 DAYS")
    assert [(r.part, r.total) for r in kept.collect()] == [("new", 1)]
    again = tiers.merged_sketches(kept, rows, "m", F.col("g"), F.col("at"))
    assert sorted((r.part, r.total) for r in again.collect()) == [("new", 2), ("old", 1)]


def test_dossiers_on_a_stream_equal_batch(spark, small, tmp_path):
    source = str(tmp_path / "in")
    composed_tickets(spark, small).drop("resolution_time_hours").coalesce(2).write.parquet(source)
    table = spark.read.parquet(source)
    stream = live.dossier_stream(live.score(live.ticket_stream(spark, source, table.schema, files_per_trigger=1)))
    live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = live.dossier_stream(live.score(table))
    assert got.count() == expected.count() > 0 and got.exceptAll(expected).count() == 0
    with pytest.raises(ValueError):
        live.dossier_stream(live.score(table), "full")
