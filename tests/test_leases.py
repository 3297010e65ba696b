"""Leases: single rules, and the stream with timers against the replay of the same requests."""

import json
import random
import time

import pytest
from pyspark.sql import Row

from notewell.streaming import leases

NAMES = [c.split()[0] for c in leases.REQUEST.split(", ")]


def request(job, seq, at, action, lease=None, fencing=None, ok=True, payload="p", seconds=900):
    return (job, seq, at, action, lease, fencing, ok, payload, seconds)


def run(*requests):
    job = leases.Job()
    return [(leases.stepped(job, Row(*NAMES)(*r)), job.status, job.fencing) for r in requests], job


def test_an_expired_lease_returns_to_its_own_route():
    told, job = run(
        request("j", 1, 0, "claim", "a"), request("j", 2, 10, "alternate", "a"), request("j", 3, 20, "claim_alternate", "b", seconds=100),
        request("j", 4, 120, "read", "b"), request("j", 5, 121, "read", "b"), request("j", 6, 130, "claim", "c"), request("j", 7, 140, "claim_alternate", "d"),
    )
    assert told == [
        ("claimed", "leased", 1), ("routed", "alternate_pending", 1), ("claimed", "alternate_leased", 2), ("read", "alternate_leased", 2),
        ("lease expired", "alternate_pending", 2), ("not claimable", "alternate_pending", 2), ("claimed", "alternate_leased", 3),
    ]
    assert job.lease == "d"


def test_old_holders_are_refused_and_retries_are_idempotent():
    told, _ = run(
        request("j", 1, 0, "claim", "a"), request("j", 2, 2000, "claim", "b"), request("j", 3, 2001, "submit", "a"), request("j", 4, 2002, "submit", "b", fencing=1),
        request("j", 5, 2003, "submit", "b", fencing=2, payload="x"), request("j", 6, 9000, "submit", "b", fencing=1, payload="x"), request("j", 7, 9001, "submit", None, payload="y"), request("j", 8, 9002, "release", "b"),
    )
    assert [o for o, _, _ in told] == ["claimed", "claimed", "lease invalid", "fencing mismatch", "submitted", "duplicate", "conflict", "not leased"]


def test_budgets_of_attempts_renewals_and_failures():
    rows = []
    for k in range(3):
        rows += [request("j", 2 * k, 10 * k, "claim", str(k)), request("j", 2 * k + 1, 10 * k + 1, "defer", str(k))]
    told, _ = run(*rows, request("j", 9, 99, "claim", "z"))
    assert [s for _, s, _ in told][1::2] == ["pending", "pending", "quarantined"] and told[-1][0] == "not claimable"
    told, job = run(request("j", 0, 0, "claim", "a", seconds=5), *[request("j", k, 50 * k, "renew", "a") for k in range(1, 6)])
    assert [o for o, _, _ in told][1:] == ["renewed"] * 3 + ["renewals used up"] * 2 and job.expires == 150 + 900
    rows = [request("j", 0, 0, "claim", "a"), request("j", 1, 1, "alternate", "a")]
    for k in range(5):
        rows += [request("j", 2 + 2 * k, 1000 * k + 2, "claim_alternate", f"b{k}"), request("j", 3 + 2 * k, 1000 * k + 3, "release_alternate", f"b{k}", ok=False, seconds=500)]
    told, _ = run(*rows[:4], request("j", 4, 100, "claim_alternate", "soon"))
    assert told[-1][0] == "backing off"
    assert run(*rows)[0][-1] == ("failing", "alternate_quarantined", 6)


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(8)
    rows, last = [], {}
    for seq in range(600):
        job = rng.choice(["hot"] * 3 + ["a", "b", "c", None])
        action = rng.choice(["claim", "claim", "claim_alternate", *leases.HELD, "dance"])
        lease = str(seq) if action.startswith("claim") else last.get(job)
        if action.startswith("claim"):
            last[job] = lease
        rows.append(request(job, seq, 1000 + 40 * seq, action, lease, rng.choice([None, None, 1]), rng.random() < 0.7, rng.choice("pq"), rng.choice([None, 0, 60, 400])))
    return rows


def test_one_hot_job_and_awkward_requests_are_replayed_in_order(spark, requests):
    df = spark.createDataFrame(requests, leases.REQUEST).repartition(7)
    got = sorted(leases.replayed(df.withColumn("outcome", df.seq)).collect(), key=lambda r: r.seq)
    jobs, want = {}, []
    for r in requests:
        job = jobs.setdefault(r[0], leases.Job())
        want.append((leases.stepped(job, Row(*NAMES)(*r)), job.status, job.fencing))
    assert [(r.outcome, r.status, r.fencing) for r in got] == want
    assert leases.replayed(df.limit(0)).count() == 0
    assert {r.job_id: r.n for r in leases.job_states(leases.replayed(df)).collect()}["hot"] == sum(r[0] == "hot" for r in requests)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def drained(spark, rows, tmp_path, mode, batches=3):
    """All rows that the stream gives for the requests, dropped as files a batch each."""
    folder = tmp_path / "requests"
    folder.mkdir()
    size = -(-len(rows) // batches)
    for k in range(batches):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(NAMES, r, strict=True))) for r in rows[k * size : (k + 1) * size]))
        time.sleep(0.02)
    out = []
    stream = leases.leased(spark.readStream.schema(leases.REQUEST).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder)), mode)
    writer = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint"))
    if mode == "EventTime":
        writer.trigger(availableNow=True).start().awaitTermination()
        return out
    running, until = writer.trigger(processingTime="1 second").start(), time.time() + 90
    while time.time() < until and not any(r.action == "timer" for r in out):
        time.sleep(0.5)
    running.stop()
    return out


def test_a_stream_gives_the_states_of_the_replay(rocks, requests, tmp_path):
    rows = [r for r in requests if r[0] is not None]
    got = drained(rocks, rows, tmp_path, "EventTime")
    want = {(r.job_id, r.seq): (r.outcome, r.status, r.fencing, r.attempts) for r in leases.replayed(rocks.createDataFrame(rows, leases.REQUEST)).collect()}
    assert {(r.job_id, r.seq): (r.outcome, r.status, r.fencing, r.attempts) for r in got if r.seq is not None} == want
    timers = [r for r in got if r.seq is None]
    assert all(r.action == "timer" and r.status in leases.HOME.values() for r in timers)


def test_timers_take_back_what_nobody_asks_for(rocks, tmp_path):
    rows = [
        request("left", 1, 1000, "claim", "a", seconds=60), request("other", 2, 1000, "claim", "b"), request("other", 3, 1001, "alternate", "b"), request("other", 4, 1002, "claim_alternate", "c", seconds=60),
        request("clock", 5, 5000, "claim", "d"), request("clock", 6, 9000, "claim", "e"),
    ]
    got = drained(rocks, rows, tmp_path, "EventTime", batches=6)
    assert {(r.job_id, r.asked_at, r.status) for r in got if r.action == "timer"} >= {("left", 1061, "pending"), ("other", 1063, "alternate_pending")}


def test_processing_time_timers_fire_for_long_expired_leases(rocks, tmp_path):
    got = drained(rocks, [request("left", 1, 1000, "claim", "a"), request("x", 2, 1000, "claim", "b"), request("y", 3, 1000, "claim", "c")], tmp_path, "ProcessingTime")
    assert ("left", "pending") in {(r.job_id, r.status) for r in got if r.action == "timer"}
