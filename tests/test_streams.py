"""The life of requests and workers as keyed state, over restarts."""

import datetime as dt
import random

from marlstone.streaming import lifecycle, queue

START = dt.datetime(2024, 1, 1)


def run(spark, folder, rows, changes, delay):
    spark.createDataFrame([(i, k, w, START + dt.timedelta(seconds=s), q) for i, k, w, s, q in rows], lifecycle.LOG).write.mode("append").parquet(f"{folder}/log")
    lifecycle.follow(spark, lambda: changes(lifecycle.log_stream(spark, f"{folder}/log", delay)), folder, partitions=3).awaitTermination(120)


def test_request_states_over_restarts_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice(["enqueue", "claim", "done", "failed", "other"]), rng.randrange(3), rng.randrange(3000), n) for n in range(300)]
    rng.shuffle(rows)  # rows of the second run lie before rows of the first, too
    for part in (rows[:150], rows[150:], []):
        run(spark, str(tmp_path), part, lifecycle.request_changes, "1 day")
    log = spark.read.parquet(f"{tmp_path}/log")
    got = {r["id"]: r for r in lifecycle.latest(spark, str(tmp_path), lifecycle.REQUESTS).collect()}
    want = {r["id"]: r for r in queue.states(log).collect()}
    assert {i: (r["state"], r["claimed_by"], r["ended_at"]) for i, r in got.items()} == {i: (r["state"], r["claimed_by"], r["ended_at"]) for i, r in want.items()}
    changes = spark.read.parquet(f"{tmp_path}/changes").collect()
    assert len({(r["id"], r["change"]) for r in changes}) == len(changes) and all(got[r["id"]]["change"] >= r["change"] for r in changes)


def test_closed_requests_stay_as_they_are(spark, tmp_path):
    life = lambda log: lifecycle.request_changes(log, keep_seconds=60)
    run(spark, str(tmp_path), [(1, "enqueue", 0, 0, 0), (1, "claim", 7, 5, 1), (1, "done", 7, 10, 2), (2, "enqueue", 0, 5000, 3)], life, "0 seconds")
    run(spark, str(tmp_path), [(1, "failed", 7, 9, 4), (1, "enqueue", 0, 6000, 5), (2, "claim", 8, 6001, 6)], life, "0 seconds")
    got = {r["id"]: (r["change"], r["state"], r["claimed_by"]) for r in lifecycle.latest(spark, str(tmp_path), lifecycle.REQUESTS).collect()}
    assert got == {1: (1, "done", 7), 2: (2, "claimed", 8)}


def test_late_workers(spark, tmp_path):
    life = lambda log: lifecycle.worker_changes(log, 100)
    run(spark, str(tmp_path), [(1, "done", 1, 0, 0), (1, "failed", 1, 10, 1), (1, "other", 2, 500, 2)], life, "0 seconds")
    first = {r["worker"]: (r["done"], r["failed"], r["late"]) for r in lifecycle.latest(spark, str(tmp_path), lifecycle.WORKERS).collect()}
    assert first == {1: (1, 1, True), 2: (0, 0, False)}  # a timer told of the first
    run(spark, str(tmp_path), [(1, "done", 1, 550, 3), (1, "done", None, 560, 4)], life, "0 seconds")
    then = {r["worker"]: (r["done"], r["failed"], r["late"]) for r in lifecycle.latest(spark, str(tmp_path), lifecycle.WORKERS).collect()}
    assert then == {1: (2, 1, False), 2: (0, 0, False)}
    late = spark.read.parquet(f"{tmp_path}/changes").where("worker = 1").orderBy("change").collect()
    assert [r["late"] for r in late] == [False, True, False]
