"""Enhancement jobs: their table, its rules as batch plans, and the same queue as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL = ("succeeded", "failed", "cancelled")
# HTTP status by error class.
STATUS = {"unauthorized": 401, "too_large": 413, "unsupported_type": 415, "unreadable_image": 422, "queue_full": 429, "backend_missing": 503, "out_of_memory": 507}


def elapsed_ms(now: Column) -> Column:
    """From start to finish (or now), two decimals; null before the start."""
    micros = F.unix_micros(F.coalesce("finished_at", now)) - F.unix_micros("started_at")
    return F.round(micros / 1000.0, 2)


def done(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*FINAL)


def stats(jobs: DataFrame) -> DataFrame:
    """One row: queued, running, finished, retained."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return jobs.agg(count("queued").alias("queued"), count("running").alias("running"), count(*FINAL).alias("finished"), F.count("*").alias("retained"))


def cancel(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """jobs with those of wanted (job_id) cancelled, if they are queued still."""
    w = wanted.select("job_id").distinct().withColumn("__c", F.lit(True))
    d = jobs.join(w, "job_id", "left")
    return d.withColumn("status", F.when(F.col("__c") & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status"))).drop("__c")


def evict(jobs: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """Without the final jobs that finished more than ttl_seconds ago; a ttl at or below 0 keeps all."""
    if ttl_seconds <= 0:
        return jobs
    old = F.unix_micros("finished_at") < F.unix_micros(now) - int(ttl_seconds * 1_000_000)
    return jobs.where(~(done() & F.coalesce(old, F.lit(False))))


def _in_order(capacity: int):
    """Goes through the events of each queue in turn; holds the admitted jobs that aren't finished."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, active = None, set()
        for p in batches:
            out = []
            for queue, job, step, holds in zip(p.queue, p.job_id, p.step, p.holds, strict=True):
                if queue != last:
                    last, active = queue, set()
                if step < 0:
                    active.discard(job)
                    continue
                out.append((queue, job, len(active), len(active) < capacity))
                if holds and len(active) < capacity:
                    active.add(job)
            yield pd.DataFrame(out, columns=["__queue", "job_id", "active", "admitted"])

    return run


def admit(requests: DataFrame, capacity: int) -> DataFrame:
    """Adds active and admitted to requests (queue, job_id, created_at, finished_at): the admitted jobs of the queue that came earlier and are unfinished, and whether these are fewer than capacity.

    Events count in the order of time, finishes first, then job_id. Refused requests take no capacity, so each decision needs
    those before it: the events of a queue are sorted and gone through once, with at most capacity jobs held. Requests without a
    queue are a queue of their own; job_id is unique within a queue.
    """
    holds = F.coalesce(F.col("finished_at") > F.col("created_at"), F.lit(True)).alias("holds")
    # A key that a null has too.
    r = requests.withColumn("__queue", F.to_json(F.struct("queue")))
    start = r.select(F.col("__queue").alias("queue"), "job_id", F.col("created_at").alias("at"), F.lit(1).alias("step"), holds)
    end = r.where("finished_at is not null").select(F.col("__queue").alias("queue"), "job_id", F.col("finished_at").alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("holds"))
    events = start.union(end).repartition("queue").sortWithinPartitions("queue", "at", "step", "job_id")
    schema = start.select(F.col("queue").alias("__queue"), "job_id", F.lit(0).cast("long").alias("active"), F.lit(True).alias("admitted")).schema
    return r.join(events.select("queue", "job_id", "step", "holds").mapInPandas(_in_order(capacity), schema), ["__queue", "job_id"]).drop("__queue")


def http_status(error: Column) -> Column:
    out = F.when(error.isNull(), 200)
    for name, code in STATUS.items():
        out = out.when(error == name, code)
    return out.otherwise(400)


def batch_report(results: DataFrame) -> DataFrame:
    """(status, n): totals of a batch; the exit code is 1 if any is an error."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def admissions(requests: DataFrame, capacity: int) -> DataFrame:
    """Streaming admission: requests (queue, job_id, kind: submit or finish[, at]) become (queue, job_id, admitted, active).

    The state of a queue is the ids of its admitted, unfinished jobs, at most capacity of them; the finish of another job changes nothing.
    Within a batch, events count in the order of at (where there is one), finishes first, then job_id. active: how many were held just before.
    """
    by = [c for c in ("at", "kind", "job_id") if c in requests.columns]

    def one(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(state.get[0] if state.exists else [])
        out = []
        for job, kind in pd.concat(list(batches)).sort_values(by)[["job_id", "kind"]].itertuples(index=False):
            if kind == "finish":
                held.pop(job, None)
                continue
            out.append((key[0], job, len(held) < capacity, len(held)))
            if len(held) < capacity:
                held[job] = None
        state.update((list(held),))
        yield pd.DataFrame(out, columns=["queue", "job_id", "admitted", "active"])

    return requests.groupBy("queue").applyInPandasWithState(one, "queue long, job_id long, admitted boolean, active long", "held array<long>", "append", "NoTimeout")
