"""Streams against the batch operators on the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wakelog.operators import episodes as ep, events as ev
from wakelog.streaming import incremental

FORM = "sortie string, signal string, ts timestamp, v double, ord long"
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def streams(spark, tmp_path):
    """A function: batches of rows (sortie, signal, seconds, v, ord), each a micro-batch, through an operator; the rows it tells."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(batches, operator, name):
        folder = str(tmp_path / name)
        for i, rows in enumerate(batches):
            at = [(s, g, EPOCH + dt.timedelta(seconds=t), v, o) for s, g, t, v, o in rows]
            spark.createDataFrame(at, FORM).coalesce(1).write.mode("append").parquet(folder)
            if i == 0:
                read = spark.readStream.schema(FORM).parquet(folder)
                query = operator(read).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
            query.processAllAvailable()
        query.stop()
        return spark.table(name)

    yield run
    spark.conf.unset(key)


def recording(rnd, sortie, n):
    t, rows = 0.0, []
    for i in range(n):
        t += rnd.choice((0.25, 0.5, 1.0, 4.0))
        rows.append((sortie, rnd.choice(("FCC1A.cap", "FCC1B.cap", "other")), t, float(rnd.randint(0, 1)), i))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_live_episodes_equal_the_batch_in_any_order(spark, streams, seed):
    rnd = random.Random(seed)
    rows = [r for s in ("s1", "s2", "s3") for r in recording(rnd, s, 120)]
    # Rows come up to nine seconds late, within the delay of ten.
    arrived = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 9))
    batches = [arrived[i : i + 90] for i in range(0, len(arrived), 90)]
    batches[-1].append(("end", "FCC1A.cap", 1000.0, 0.0, 0))
    told = streams(batches, lambda df: incremental.live_episodes(df, "cap", 0.0, 1.0), f"episodes_{seed}")
    seconds = lambda c: (F.unix_micros(c) - int(EPOCH.timestamp() * 1e6)) / 1e6
    last = told.groupBy("sortie", "episode").agg(F.max_by(F.struct("trigger_signal", seconds("start_ts").alias("a"), seconds("end_ts").alias("b")), F.col("status") == "closed").alias("x"), F.count("*").alias("n"))
    got = {(r["sortie"], r["episode"]): tuple(r["x"]) for r in last.collect()}
    samples = spark.createDataFrame([(s, "a", g, t, v, o) for s, g, t, v, o in rows], "sortie string, source string, signal string, t double, v double, ord long")
    want = ep.extract_episodes(ev.transitions(samples), "cap", 0.0, 1.0)
    assert got == {(r["sortie"], r["episode"]): (r["trigger_signal"], r["start_t"], r["end_t"]) for r in want.collect()}
    assert len(got) > 20 and last.where("n > 2").count() == 0


def test_state_ends_though_late_rows_come(streams):
    late = [("s1", "cap", 1.0, 1.0, 9)]
    batches = [
        [("s1", "cap", 0.0, 0.0, 0), ("s1", "cap", 1.0, 1.0, 1), ("s2", "cap", 0.0, 0.0, 0)],
        [("s2", "cap", 50.0, 1.0, 1)], late, [("s2", "cap", 90.0, 0.0, 2)], late,
        # The state of s1 has ended, so it counts anew; its open episode never got an end.
        [("s1", "cap", 100.0, 0.0, 2), ("s1", "cap", 101.0, 1.0, 3), ("s2", "cap", 200.0, 0.0, 3)],
    ]
    told = streams(batches, lambda df: incremental.live_episodes(df, "cap", 0.0, 1.0, idle_ms=60_000), "ended")
    assert [(r["episode"], r["status"], r["start_ts"].second) for r in told.where("sortie = 's1'").orderBy("start_ts").collect()] == [(1, "open", 1), (1, "open", 41)]


def test_live_transitions_and_sessions(streams):
    rows = [("s1", "a", 0.0, 0.0, 0), ("s1", "a", 0.5, 1.0, 1), ("s1", "a", 5.0, 1.0, 2), ("s1", "a", 6.0, 0.0, 3)]
    batches = [rows[:2], rows[2:], [("s1", "a", 1.0, 5.0, 4)], [("s2", "a", 100.0, 0.0, 0)]]
    told = streams(batches, lambda df: incremental.live_transitions(df.drop("ord")), "moves").collect()
    assert [(r["signal"], r["from_v"], r["to_v"]) for r in sorted(told, key=lambda r: r["ts"])] == [("a", 0.0, 1.0), ("a", 1.0, 0.0)]
    sessions = streams(batches, lambda df: incremental.live_sessions(df, "2 seconds"), "sessions").where("sortie = 's1'").collect()
    assert sorted(r["n"] for r in sessions) == [2, 2] or sorted(r["n"] for r in sessions) == [2, 3]
