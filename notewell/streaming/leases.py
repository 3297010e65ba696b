"""Leases of jobs: claims, renewals, both routes, submissions, and timers that take back what expired.

A request names its job, an order (``seq``), a time in seconds (``asked_at``), an action and the ``lease`` that
the caller holds; a claim brings the id that its lease will have. Each grant raises the job's fencing
token, which never falls. A lease that has expired returns its job to the queue of its own route,
whoever notices first: the next request or the timer.

``stepped`` is the rule of one request, and the same code serves ``replayed`` (a table of requests,
each job's in one sorted run, with constant memory whatever their number) and ``leased`` (a stream
with keyed state and timers).

Requests of one job are ordered by seq, then by all other columns; a null job, or an unknown action,
gives the outcome ``unknown``; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Budgets and bounds in seconds of the queue's rules.
MAX_ATTEMPTS, MAX_RENEWS, MAX_PROVIDER_FAILURES = 3, 3, 5
MIN_LEASE, MAX_LEASE, MAX_ALTERNATE_LEASE = 60, 900, 86_400

REQUEST = "job_id string, seq bigint, asked_at bigint, action string, lease string, fencing bigint, ok boolean, payload string, seconds bigint"
OUTCOME = "job_id string, seq bigint, asked_at bigint, action string, outcome string, status string, fencing bigint, attempts bigint, expires bigint"
STATE = "status string, lease string, was string, payload string, fencing bigint, expires bigint, renews bigint, attempts bigint, alternate_attempts bigint, failures bigint, next_at bigint"

LEASED, ALTERNATE = "leased", "alternate_leased"
#: The queue to which each kind of lease returns.
HOME = {LEASED: "pending", ALTERNATE: "alternate_pending"}


@dataclass
class Job:
    status: str = "pending"
    lease: str | None = None
    was: str | None = None
    payload: str | None = None
    fencing: int = 0
    expires: int | None = None
    renews: int = 0
    attempts: int = 0
    alternate_attempts: int = 0
    failures: int = 0
    next_at: int | None = None

    def close(self, status: str) -> None:
        self.status, self.lease, self.expires = status, None, None

    def grant(self, status: str, lease: str, until: int) -> None:
        self.status, self.lease, self.was, self.expires, self.renews = status, lease, None, until, 0
        self.fencing += 1

    def expire(self, now: int) -> bool:
        """Whether the lease has expired by now; it returns to its own route then."""
        if self.status not in HOME or self.expires is None or self.expires >= now:
            return False
        self.was = self.lease
        self.close(HOME[self.status])
        return True

    def refused(self, alternate: bool) -> bool:
        """Count an unusable answer against the route's own budget; whether that is used up."""
        if alternate:
            self.alternate_attempts += 1
            return self.alternate_attempts >= MAX_ATTEMPTS
        self.attempts += 1
        return self.attempts >= MAX_ATTEMPTS


def _within(seconds: int | None, most: int) -> int:
    return max(MIN_LEASE, min(most if seconds is None else seconds, most))


def _claim(job: Job, r: Row) -> str:
    if job.status not in ("pending", "deferred") or job.attempts >= MAX_ATTEMPTS or r.lease is None:
        return "not claimable"
    job.grant(LEASED, r.lease, r.asked_at + _within(r.seconds, MAX_LEASE))
    return "claimed"


def _claim_alternate(job: Job, r: Row) -> str:
    if job.status != "alternate_pending" or job.alternate_attempts >= MAX_ATTEMPTS or r.lease is None:
        return "not claimable"
    if job.next_at is not None and job.next_at > r.asked_at:
        return "backing off"
    job.grant(ALTERNATE, r.lease, r.asked_at + _within(r.seconds, MAX_ALTERNATE_LEASE))
    return "claimed"


def _submit(job: Job, r: Row) -> str:
    if r.fencing is not None and r.fencing != job.fencing:
        return "fencing mismatch"
    if r.ok:
        job.status, job.payload, job.expires = "submitted", r.payload, None
        return "submitted"
    alternate = job.status == ALTERNATE
    over = job.refused(alternate)
    job.close(("alternate_quarantined" if alternate else "quarantined") if over else HOME[job.status])
    return "invalid"


def _release(job: Job, r: Row) -> str:
    job.close("pending")
    return "released"


def _defer(job: Job, r: Row) -> str:
    over = job.refused(False)
    job.close("quarantined" if over else "pending")
    return "deferred"


def _alternate(job: Job, r: Row) -> str:
    job.close("alternate_quarantined" if job.alternate_attempts >= MAX_ATTEMPTS else "alternate_pending")
    job.next_at = None
    return "routed"


def _renew(job: Job, r: Row) -> str:
    if job.renews >= MAX_RENEWS:
        return "renewals used up"
    job.expires, job.renews = r.asked_at + MAX_LEASE, job.renews + 1
    return "renewed"


def _fail_alternate(job: Job, r: Row) -> str:
    if job.refused(True):
        job.close("alternate_quarantined")
    return "failed"


def _release_alternate(job: Job, r: Row) -> str:
    job.failures += not r.ok
    if not r.ok and job.failures >= MAX_PROVIDER_FAILURES:
        job.close("alternate_quarantined")
        return "failing"
    job.close("alternate_pending")
    job.next_at = r.asked_at + r.seconds if r.seconds else None
    return "given back"


#: Actions of the holder of a lease, with the kinds of lease that they need.
HELD = {
    "read": ((LEASED, ALTERNATE), lambda job, r: "read"), "submit": ((LEASED, ALTERNATE), _submit), "release": ((LEASED,), _release), "defer": ((LEASED,), _defer), "alternate": ((LEASED,), _alternate),
    "renew": ((LEASED,), _renew), "fail_alternate": ((ALTERNATE,), _fail_alternate), "release_alternate": ((ALTERNATE,), _release_alternate),
}


def stepped(job: Job, r: Row) -> str:
    """The outcome of a request; ``job`` becomes what it is after it."""
    if r.job_id is None or r.asked_at is None:
        return "unknown"
    job.expire(r.asked_at)
    if r.action == "claim":
        return _claim(job, r)
    if r.action == "claim_alternate":
        return _claim_alternate(job, r)
    if r.action not in HELD:
        return "unknown"
    if r.action == "submit" and job.status == "submitted":
        return "duplicate" if r.payload == job.payload else "conflict"
    if r.lease is None or r.lease != job.lease:
        return "lease expired" if r.lease is not None and r.lease == job.was else "lease invalid"
    kinds, act = HELD[r.action]
    return act(job, r) if job.status in kinds else "not leased"


def _told(job: Job, r: Row) -> tuple:
    outcome = stepped(job, r)
    return r.job_id, r.seq, r.asked_at, r.action, outcome, job.status, job.fencing, job.attempts, job.expires


def _outcome(*values) -> Row:
    return Row(*[c.split()[0] for c in OUTCOME.split(", ")])(*values)


def _requests(df: DataFrame) -> DataFrame:
    return df.select(*[df[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in REQUEST.split(", ")])


def replayed(requests: DataFrame) -> DataFrame:
    """A row for each request (``REQUEST``): its outcome and what its job is after it (``OUTCOME``).

    Jobs are dealt over partitions and read in order; one job is in memory at a time, and no more than its state.
    """
    names = [c.split()[0] for c in REQUEST.split(", ")]

    def run(batches):
        held, job = None, Job()
        for batch in batches:
            out = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                r = Row(*names)(*values)
                if r.job_id != held:
                    held, job = r.job_id, Job()
                out.append(_told(job, r))
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64() if "bigint" in c else pa.string() for c in OUTCOME.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in OUTCOME.split(", ")])

    ordered = _requests(requests).repartition("job_id").sortWithinPartitions("job_id", "seq", *[n for n in names if n not in ("job_id", "seq")])
    return ordered.mapInArrow(run, OUTCOME)


def job_states(outcomes: DataFrame) -> DataFrame:
    """(job_id, n, status, fencing, attempts, expires): each job after its last request."""
    last = F.max_by(F.struct("status", "fencing", "attempts", "expires"), "seq")
    return outcomes.where("job_id is not null").groupBy("job_id").agg(F.count("*").alias("n"), last.alias("j")).select("job_id", "n", "j.*")


class LeaseProcessor(StatefulProcessor):
    """Keyed state of a stream of requests, with a timer at the end of each lease."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", STATE)

    def _job(self) -> Job:
        return Job(*self.held.get()) if self.held.exists() else Job()

    def _keep(self, job: Job) -> None:
        self.held.update(astuple(job))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.expires is not None:
            self.handle.registerTimer((job.expires + 1) * 1000)  # a lease holds to the end of its last second

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        job = self._job()
        order = lambda r: (r.seq is None, r.seq)
        for r in sorted(rows, key=order):
            yield _outcome(*_told(job, r))
        self._keep(job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job, now = self._job(), expiredTimerInfo.getExpiryTimeInMs() // 1000
        if job.expire(now):
            yield _outcome(key[0], None, now, "timer", "lease expired", job.status, job.fencing, job.attempts, job.expires)
        self._keep(job)

    def close(self) -> None:
        pass


def leased(requests: DataFrame, time_mode: str = "ProcessingTime", late: str = "0 seconds") -> DataFrame:
    """The outcomes of a stream of requests, and a row for each lease that a timer takes back.

    Needs the RocksDB state store. Processing-time timers may always fire, so such a stream needs a
    processing-time trigger (with availableNow it never ends). With ``EventTime``, timers follow the requests' own times, ``late`` behind
    the newest; requests from before that are dropped, so ``late`` must cover how far they may stray.
    """
    held = _requests(requests)
    if time_mode == "EventTime":
        held = held.withColumn("moment", F.timestamp_seconds("asked_at")).withWatermark("moment", late)
    return held.groupBy("job_id").transformWithState(LeaseProcessor(), OUTCOME, "Append", time_mode)


assert [f.name for f in fields(Job)] == [c.split()[0] for c in STATE.split(", ")]
