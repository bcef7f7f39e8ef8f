"""Job states and the ring of measurements, batch by batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import jobs
from lamina.streaming import jobs as stream

EVENTS = "job_id string, ts timestamp, event_id long, status string, value double"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def told(spark, tmp_path):
    """Tells events as files of a stream, one batch at a time."""
    source = f"{tmp_path}/events"

    def tell(rows, run):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        run(spark.readStream.schema(EVENTS).parquet(source)).awaitTermination()

    return tell


def test_job_states_of_a_stream(spark, told, tmp_path):
    """Events out of order within the watermark, told again, refused, and late ones."""
    rng = random.Random(4)
    folder, state = f"{tmp_path}/store", f"{tmp_path}/state"
    run = lambda s: stream.follow(s, folder, state)
    first = [(f"j{rng.randrange(12)}", at(rng.randrange(60)), i, rng.choice(["PROCESSING", "COMPLETED", "FAILED", "SKIPPED", "OTHER"]), 1.0) for i in range(120)]
    first += first[:10] + [(None, at(5), 500, "PROCESSING", 1.0)]
    told(first, run)
    second = [(f"j{rng.randrange(12)}", at(60 + rng.randrange(30)), 200 + i, rng.choice(["PROCESSING", "COMPLETED"]), 1.0) for i in range(40)]
    told(second, run)
    told([("clock", at(500), 900, "PROCESSING", 1.0)], run)
    told([("j1", at(1), 901, "FAILED", 1.0), ("clock", at(501), 902, "OTHER", 1.0)], run)  # far too late
    want = {r.job_id: (r.state, r.since, r.n_events, r.n_refused) for r in jobs.states(spark.createDataFrame(first + second, EVENTS)).collect()}
    got = {r.job_id: (r.state, r.since, r.n_events, r.n_refused) for r in stream.current(spark, folder).where("job_id <> 'clock'").collect()}
    assert got == want and len(got) == 12


def test_ring_equals_the_batch_query_after_every_batch(spark, told, tmp_path):
    rng = random.Random(5)
    folder, state = f"{tmp_path}/store", f"{tmp_path}/state"
    every = []
    for batch in range(4):
        rows = [("j", at(rng.randrange(100)), 100 * batch + i, "OTHER", rng.random()) for i in range((3, 60, 0, 25)[batch] or 1)]
        every += rows
        told(rows + rows[:2], lambda s: stream.measure(s, folder, state, last=40))
        ring = stream.ring(spark, folder)
        want = jobs.recent_mean(spark.createDataFrame(every, EVENTS), last=40).first()
        assert (round(ring.agg(F.avg("value")).first()[0], 6), ring.count()) == (want.mean_value, want.n)
    stream.reset(spark, folder)
    assert stream.ring(spark, folder).count() == 0
    told([("j", at(1), 999, "OTHER", 2.0)], lambda s: stream.measure(s, folder, state, last=40))
    assert [r.value for r in stream.ring(spark, folder).collect()] == [2.0]
