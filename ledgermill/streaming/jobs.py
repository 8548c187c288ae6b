"""The states of jobs from their events: legal moves only, three attempts with a fixed wait between them, pause and resume, and the intake's mirrored status.

``job_states`` folds a table, ``JobStream`` a stream. The stream keeps the events of the watermark's delay beside each job's settled state: events that come out of
order take their place, repeated ones are known by their id, and what it tells of a job is the fold of both. A timer settles what the watermark has passed, and
ends the wait of a failed attempt, also where no event follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgermill.sources.tables import scratch

#: The status after an event, by the status before. JOB_QUEUED fits any; a failed attempt waits while there are more.
MOVES = {
    ("QUEUED", "JOB_STARTED"): "PROCESSING", ("PROCESSING", "JOB_PROGRESS"): "PROCESSING", ("PROCESSING", "JOB_COMPLETED"): "DONE", ("PROCESSING", "JOB_FAILED"): "ERROR",
    ("QUEUED", "PAUSED"): "PAUSED", ("PROCESSING", "PAUSED"): "PAUSED", ("DELAYED", "PAUSED"): "PAUSED", ("PAUSED", "RESUMED"): "QUEUED", ("ERROR", "RETRIED"): "QUEUED",
}
#: Attempts of a job, and seconds between them.
ATTEMPTS, WAIT = 3, 5
#: The intake's status by the job's; a pause leaves it.
INTAKE = {"QUEUED": "QUEUED", "PROCESSING": "PROCESSING", "DONE": "DONE", "ERROR": "ERROR", "DELAYED": "ERROR"}

STATE = "status string, intake_status string, attempt int, retry_at long, progress long, moves long, rejected long, last_event long"
KINDS = dict(x.split() for x in STATE.split(", "))
NAMES = list(KINDS)


def _micros(events: DataFrame) -> DataFrame:
    """Times as microseconds since 1970, which no time zone of a worker changes; ts stays for the watermark."""
    ts = F.col("ts").cast("timestamp")
    return events.select("job", "event_id", F.unix_micros(ts).alias("at"), "kind", F.col("current").cast("long").alias("current"), ts.alias("ts"))


def _shown(states: DataFrame) -> DataFrame:
    return states.select("job", *[F.timestamp_micros(n).alias(n) if n == "retry_at" else F.col(n) for n in NAMES])


# over a table -------------------------------------------------------------------------------------------------------------------------


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _due(s: Column, at: Column) -> Column:
    """The state at a time: a wait that is over puts the job back into its queue."""
    over = F.coalesce((s["status"] == "DELAYED") & (s["retry_at"] <= at), F.lit(False))
    queued = {"status": F.lit("QUEUED"), "intake_status": F.lit("QUEUED"), "retry_at": F.lit(None).cast("long"), "moves": s["moves"] + 1}
    return F.when(over, F.struct(*[queued.get(n, s[n]).alias(n) for n in NAMES])).otherwise(s)


def _after(s: Column, e: Column) -> Column:
    next_ = F.when(e["kind"] == "JOB_QUEUED", "QUEUED").otherwise(_lookup({f"{a} {b}": c for (a, b), c in MOVES.items()}, F.concat_ws(" ", s["status"], e["kind"])))
    waits = (next_ == "ERROR") & (s["attempt"] < ATTEMPTS)
    status = F.when(waits, "DELAYED").otherwise(next_)
    new = {
        "status": status, "intake_status": F.coalesce(_lookup(INTAKE, status), s["intake_status"]),
        "attempt": F.when(next_ == "QUEUED", 1).when(waits, s["attempt"] + 1).otherwise(s["attempt"]),
        "retry_at": F.when(waits, e["at"] + WAIT * 1_000_000),
        "progress": F.when(next_ == "QUEUED", F.lit(0)).when(e["kind"] == "JOB_PROGRESS", e["current"]).otherwise(s["progress"]),
        "moves": s["moves"] + 1, "rejected": s["rejected"], "last_event": e["event_id"],
    }
    refused = {"rejected": s["rejected"] + 1, "last_event": e["event_id"]}
    row = lambda values: F.struct(*[values.get(n, s[n]).cast(KINDS[n]).alias(n) for n in NAMES])
    return F.when(next_.isNull(), row(refused)).otherwise(row(new))


def job_states(events: DataFrame, as_of: Column) -> DataFrame:
    """job and its state at ``as_of``, after its events (job, event_id, ts, kind, current) in their order; repeated event ids count once. A job's events are few and stand in one array."""
    rows = _micros(events).groupBy("job").agg(F.array_sort(F.collect_set(F.struct("at", "event_id", "kind", "current"))).alias("events"))
    start = F.struct(*[F.lit({"attempt": 0, "progress": 0, "moves": 0, "rejected": 0}.get(n)).cast(kind).alias(n) for n, kind in KINDS.items()])

    def step(s: Column, e: Column) -> Column:
        return F.get(F.transform(F.array(_due(s, e["at"])), lambda x: _after(x, e)), F.lit(0))

    end = F.unix_micros(as_of.cast("timestamp"))
    return _shown(rows.select("job", F.aggregate("events", start, step, lambda s: _due(s, end)).alias("s")).select("job", "s.*"))


# over a stream ------------------------------------------------------------------------------------------------------------------------


class Job:
    """One job's state as plain values."""

    def __init__(self, values: tuple | None = None):
        self.status, self.intake_status, self.attempt, self.retry_at, self.progress, self.moves, self.rejected, self.last_event = values or (None, None, 0, None, 0, 0, 0, None)

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in NAMES)

    def _set(self, status: str) -> None:
        self.status, self.intake_status, self.moves = status, INTAKE.get(status, self.intake_status), self.moves + 1
        self.retry_at = None

    def due(self, at: int) -> None:
        if self.status == "DELAYED" and self.retry_at <= at:
            self._set("QUEUED")

    def apply(self, event: tuple) -> None:
        at, self.last_event, kind, current = event
        self.due(at)
        status = "QUEUED" if kind == "JOB_QUEUED" else MOVES.get((self.status, kind))
        if status is None:
            self.rejected += 1
        elif status == "ERROR" and self.attempt < ATTEMPTS:
            self._set("DELAYED")
            self.attempt, self.retry_at = self.attempt + 1, at + WAIT * 1_000_000
        else:
            self._set(status)
            if status == "QUEUED":
                self.attempt, self.progress = 1, 0
            elif kind == "JOB_PROGRESS":
                self.progress = current


class JobStates(StatefulProcessor):
    """State of a key: the settled job with its one timer, and the events that the watermark hasn't passed, read and written at once. The timer stands at the earliest of them or at the end of a wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", STATE + ", told long, timer long")
        self.pending = handle.getListState("pending", "at long, event_id long, kind string, current long")

    def _job(self) -> tuple[Job, int, int | None]:
        found = self.settled.get()
        return (Job(tuple(found[:-2])), found[-2], found[-1]) if found else (Job(), 0, None)

    def _events(self) -> list[tuple]:
        return sorted((tuple(v) for v in self.pending.get()), key=lambda e: e[:2])

    def _tell(self, key, job: Job, events: list[tuple], told: int, timer: int | None) -> pd.DataFrame:
        """What the job is after its events; it is called again at the earliest time that settles something, if no timer stands there."""
        ends = [at for at in (events[0][0] if events else None, job.retry_at) if at is not None]
        if ends and (timer is None or -(-min(ends) // 1000) < timer):
            timer = -(-min(ends) // 1000)
            self.handle.registerTimer(timer)
        now = Job(job.values())
        for e in events:
            now.apply(e)
        self.settled.update((*job.values(), told + 1, timer))
        return pd.DataFrame([(key[0], *now.values(), told + 1)], columns=["job", *NAMES, "told"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, told, timer = self._job()
        known = self._events()
        ids, new = {e[1] for e in known}, []
        for part in rows:
            for event_id, at, kind, current in zip(part["event_id"], part["at"], part["kind"], part["current"], strict=True):
                if event_id not in ids:
                    ids.add(event_id)
                    new.append((int(at), int(event_id), kind, None if pd.isna(current) else int(current)))
        if new:
            self.pending.appendList(new)
        yield self._tell(key, job, sorted(known + new, key=lambda e: e[:2]), told, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = timerValues.getCurrentWatermarkInMs() * 1000
        job, told, timer = self._job()
        if timer is not None and timer <= at // 1000:
            timer = None
        events = self._events()
        if job.retry_at is None and not events:
            return
        passed = sum(e[0] <= at for e in events)
        for e in events[:passed]:
            job.apply(e)
        if passed == len(events):
            self.pending.clear()
        elif passed:
            self.pending.put(events[passed:])
        job.due(at)
        yield self._tell(key, job, events[passed:], told, timer)

    def close(self) -> None:
        pass


class JobStream:
    """Job states of a stream of events (job, event_id, ts, kind, current), kept under a folder that all executors share."""

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark, self.at = spark, at or scratch(spark, "jobs")

    def run(self, events: DataFrame, delay: str = "10 minutes", every: str | None = None):
        """Starts the stream: all that is there now, or with ``every`` a batch each so often until it is stopped. Events later than the delay are left out.
        Each batch writes what it tells under its number, so a batch that is run again replaces itself."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        told = _micros(events).withWatermark("ts", delay).groupBy("job").transformWithStateInPandas(JobStates(), f"job long, {STATE}, told long", "Update", "EventTime")

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{self.at}/told/step={batch}")

        stream = told.writeStream.outputMode("update").option("checkpointLocation", f"{self.at}/progress").foreachBatch(write)
        return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()

    def states(self) -> DataFrame:
        """job and its newest state."""
        rows = self.spark.read.schema(f"job long, {STATE}, told long, step long").parquet(f"{self.at}/told")
        newest = rows.groupBy("job").agg(F.max_by(F.struct(*NAMES), "told").alias("s"))
        return _shown(newest.select("job", "s.*"))
