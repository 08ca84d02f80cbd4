"""Silences by ticks against the stateful stream, and for many entities."""

import datetime
import time

from pyspark.sql import functions as F

from kelpline.plans import registry, runs
from kelpline.sources import dims
from kelpline.streaming import jobs, silence
from tests.compare import agree, duck
from tests.test_incidents import write_events

DAY = 86_400_000


def test_ticks_tell_what_the_stateful_stream_tells(spark, small):
    """From files in which fixes come late; each tick runs twice."""
    folder, o = runs._landed(spark, small, shift=F.when(F.col("obs_id") % 7 == 0, DAY).otherwise(0))
    boxes = dims.watchboxes(spark)
    tick = silence.silence_tick(boxes, f"{folder}/kept", f"{folder}/silences", lateness_ms=2 * DAY, compact_every=2)

    def twice(batch, epoch):
        tick(batch, epoch)
        tick(batch, epoch)

    jobs.run_ticks(o, twice, f"{folder}/at_ticks").awaitTermination()
    with runs._rocks(spark):
        streamed = runs._drained(silence.silences(o, boxes, lateness="2 days"), folder)
    told = spark.read.parquet(f"{folder}/silences")
    rows = lambda df: sorted(map(str, df.select(*silence.SILENCE_COLUMNS, F.when(F.col("state") == "closed", F.col("v.verdict"))).collect()))
    want = rows(streamed)
    assert rows(told) == want and told.where("state = 'open'").count() > 5 and told.where("state = 'closed'").count() > 50


def test_many_entities_take_no_work_of_their_own(spark, tmp_path):
    """6000 ships and aircraft, heard in each of three files: at some hundredths of a second for each and file it was minutes."""
    at = lambda user, k: datetime.datetime(2024, 1, 2) + datetime.timedelta(days=10 * k, seconds=37 * user % 86400)
    write_events(spark, str(tmp_path), [(3 * user + k, at(user, k), user, "view", 30.0, '{"k": 50}') for user in range(8000) for k in range(3)])
    began = time.time()
    got = registry.queries()["stream_silences"](spark, str(tmp_path))
    assert got.count() > 6000
    assert time.time() - began < 75
    agree(got, duck(str(tmp_path)), registry.oracle_sql()["stream_silences"])
