"""Loop counts in state: caps, initial counts, timers of event time with late data, and a time to live."""

import datetime
import time

import pytest

from tessera.streaming import events as S

SCHEMA = "workflow long, event_id long, ts timestamp, route string"


@pytest.fixture
def stream(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def step(rows, **how):
        spark.createDataFrame([(w, i, datetime.datetime(2024, 1, 1, 0, m), r) for w, i, m, r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = S.loops(events, 3, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        once = {"once": True} if "ttl" in how else {"availableNow": True}  # by processing time there is always a next batch
        query = out.trigger(**once).start()
        done = query.awaitTermination(60)
        query.stop()
        assert done
        now = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
        new = list(now)
        for x in step.seen:
            new.remove(x)
        step.seen = now
        return new

    step.seen = []
    yield step
    spark.conf.set(name, before)


def test_cap_timer_and_initial_state(spark, stream):
    how = {"gap": 20 * 60_000, "initial": spark.createDataFrame([(1, "a", 2), (9, "z", 1)], "workflow long, route string, n long")}
    assert stream([(1, 1, 0, "a"), (1, 2, 1, "a"), (2, 3, 1, "b")], **how) == [(1, "a", 3, "continue"), (1, "a", 4, "max_iterations_exceeded"), (2, "b", 1, "continue")]
    # a later event of 2 puts its timer off; the watermark passes that of 1, which comes to rest
    assert stream([(2, 4, 50, "b")], **how) == [(1, None, 4, "expired"), (2, "b", 2, "continue")]
    # an event behind the watermark is left out, and 1 begins anew
    assert stream([(2, 5, 2, "b"), (1, 6, 55, "a")], **how) == [(1, "a", 1, "continue")]


def test_time_to_live(spark, stream):
    how = {"ttl": 4000}
    assert stream([(1, 1, 0, "a"), (1, 2, 0, "a"), (1, 3, 0, "b")], **how) == [(1, "a", 1, "continue"), (1, "a", 2, "continue"), (1, "b", 1, "continue")]
    time.sleep(5)
    assert stream([(1, 4, 0, "a")], **how) == [(1, "a", 1, "continue")]  # the count of before is gone
    with pytest.raises(ValueError, match="either"):
        S.loops(spark.createDataFrame([], SCHEMA), 3)
