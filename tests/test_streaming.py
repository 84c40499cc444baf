import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillveil.streaming import detection as S

SCHEMA = "doc_id long, ts timestamp, text string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def docs(spark, path, rows):
    at = [(i, START + timedelta(minutes=m), t) for i, m, t in rows]
    spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, at):
    found = S.once(S.entities(S.stamped(S.source(spark, path, SCHEMA)), use_scripts=False))
    query = S.started(S.counts(found, window="10 minutes", late=None), f"{at}/out", f"{at}/log")
    assert query.awaitTermination(120)
    rows = spark.read.schema("window struct<start:timestamp,end:timestamp>, entity_type string, n long").parquet(f"{at}/out")
    return sorted((int(r.s), r.entity_type, r.n) for r in rows.select(((F.unix_timestamp("window.start") - int(START.timestamp())) / 60).alias("s"), "entity_type", "n").collect())


def test_two_runs_over_a_growing_folder(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    seen = S.Progress()
    spark.streams.addListener(seen)
    try:
        docs(spark, path, [(1, 1, "a@b.cc"), (2, 5, "c@d.ee and a@b.cc"), (3, 12, "x@y.zz"), (4, 31, None), (5, 32, "q@r.ss")])
        # The stream's time is 32 - 10 minutes: the windows from 0 and 10 are closed.
        first = run(spark, path, at)
        assert first == [(0, "EMAIL", 3), (10, "EMAIL", 1)]
        # 5 comes again, 6 comes far too late, 7 is new, 8 moves the time on.
        docs(spark, path, [(5, 32, "q@r.ss"), (6, 2, "late@late.com"), (7, 33, "u@v.ww"), (8, 60, "nothing")])
        second = run(spark, path, at)
        assert second == [*first, (30, "EMAIL", 2)]
        assert run(spark, path, at) == second
        time.sleep(2)  # the listener is told afterwards
        assert seen.total("rows") == 9 and seen.total("late_rows") >= 1 and not seen.errors
    finally:
        spark.streams.removeListener(seen)


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    docs(spark, path, [(1, 1, "a@b.cc"), (2, 40, "c@d.ee")])
    found = S.entities(S.source(spark, path, SCHEMA), use_scripts=False).select("doc_id", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("entity_type")).alias("entity_type"))
    with pytest.raises(Exception, match="stop"):
        S.started(found, f"{at}/out", f"{at}/log").awaitTermination(120)
    whole = S.entities(S.source(spark, path, SCHEMA), use_scripts=False).select("doc_id", "entity_type")
    assert S.started(whole, f"{at}/out", f"{at}/log").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{at}/out").collect())) == [(1, "EMAIL"), (2, "EMAIL")]
    assert os.path.isdir(f"{at}/log/commits")


def test_counts_keep_their_own_lateness(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    docs(spark, path, [(1, 1, "a@b.cc"), (2, 30, "c@d.ee")])
    query = S.started(S.counts(S.entities(S.source(spark, path, SCHEMA), use_scripts=False)), f"{at}/out", f"{at}/log")
    assert query.awaitTermination(120)
    assert [r.n for r in spark.read.parquet(f"{at}/out").collect()] == [1]
