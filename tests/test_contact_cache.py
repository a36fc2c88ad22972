"""The contact cache over two runs of one checkpoint, from a batch table."""

from datetime import datetime, timedelta

import pytest

from recordweave.streaming import contact_cache

SCHEMA = "domain string, source string, kind string, email string, retry boolean, at timestamp"
T0 = datetime(2024, 1, 1)


def day(n, hours=0):
    return T0 + timedelta(days=n, hours=hours)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_two_runs_from_one_checkpoint(spark, tmp_path, rocks):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    before = spark.createDataFrame([("old", "s", "found", "a@old.example", T0), ("cold", "s", "missed", None, T0)], "domain string, source string, kind string, email string, at timestamp")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = contact_cache.decisions(stream, before).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination()

    def got(first):
        return sorted((r.domain, r.source, r.at, r.decision, r.email) for r in spark.read.parquet(out).collect() if (r.at < day(5)) == first)

    run([("old", "s", "ask", None, False, day(1)), ("cold", "s", "ask", None, False, day(1)), ("cold", "s", "ask", None, True, day(1, 1)), ("cold", "other", "ask", None, False, day(1)), ("new", "s", "ask", None, False, day(1))])
    assert got(True) == [("cold", "other", day(1), "fetch", None), ("cold", "s", day(1), "cooldown", None), ("cold", "s", day(1, 1), "fetch", None), ("new", "s", day(1), "fetch", None), ("old", "s", day(1), "found", "a@old.example")]
    run([("new", "s", "missed", None, False, day(6))])
    # The state of both runs holds: the old mailbox for good, the first miss until its cool-down is over, the second still.
    run([("old", "x", "ask", None, False, day(40)), ("cold", "s", "ask", None, False, day(13)), ("cold", "s", "ask", None, False, day(14)), ("new", "s", "ask", None, False, day(19)), ("new", "s", "found", "b@new.example", False, day(19)), ("cold", None, None, None, False, day(20))])
    assert got(False) == [("cold", "s", day(13), "cooldown", None), ("cold", "s", day(14), "fetch", None), ("new", "s", day(19), "cooldown", None), ("old", "x", day(40), "found", "a@old.example")]
    # The watermark has passed all cool-downs: a miss of then is forgotten, what was found is not.
    run([("new", "s", "ask", None, False, day(60)), ("cold", "s", "ask", None, False, day(60))])
    assert [x for x in got(False) if x[2] == day(60)] == [("cold", "s", day(60), "fetch", None), ("new", "s", day(60), "found", "b@new.example")]
