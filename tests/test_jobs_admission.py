import random
from datetime import datetime, timedelta

from rasterloom.streaming import jobs


def test_saturated_queue_equals_one_by_one(spark):
    r = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = []
    for job in range(600):
        at = t0 + timedelta(seconds=r.randrange(900))
        rows.append((job % 3 or None, job, at, r.choice([None, at, *[at + timedelta(seconds=r.randint(1, 90)) for _ in range(8)]])))
    want = {}
    for queue in (None, 1, 2):
        events = [(c, 1, j, f) for q, j, c, f in rows if q == queue] + [(f, -1, j, None) for q, j, c, f in rows if q == queue and f]
        active = set()
        for at, step, job, end in sorted(events, key=lambda e: e[:3]):
            if step < 0:
                active.discard(job)
            else:
                want[job] = (len(active), len(active) < 5)
                if len(active) < 5 and end != at:
                    active.add(job)
    df = spark.createDataFrame(rows, "queue long, job_id long, created_at timestamp, finished_at timestamp").repartition(5)
    got = {g.job_id: (g.active, g.admitted) for g in jobs.admit(df, 5).collect()}
    assert got == want
    assert len({ok for _, ok in got.values()}) == 2 and max(n for n, _ in got.values()) == 5


def test_stream_equals_batch_on_a_saturated_queue(spark, tmp_path):
    r = random.Random(4)
    t0 = datetime(2024, 1, 1)
    jobs_of = []
    for job in range(200):
        at = t0 + timedelta(seconds=7 * r.randrange(300))
        jobs_of.append((job % 2, job, at, r.choice([None, at + timedelta(seconds=r.randint(1, 600)), at + timedelta(seconds=r.randint(1, 60))])))
    want = {g.job_id: (g.admitted, g.active) for g in jobs.admit(spark.createDataFrame(jobs_of, "queue long, job_id long, created_at timestamp, finished_at timestamp"), 4).collect()}
    events = [(q, j, "submit", c) for q, j, c, _ in jobs_of] + [(q, j, "finish", f) for q, j, _, f in jobs_of if f]
    events.sort(key=lambda e: (e[3], e[2], e[1]))
    # Batches cut the events where time goes on; within one they come in any order.
    for k in range(5):
        some = [e for e in events if int((e[3] - t0).total_seconds()) // 500 == k or k == 4 and (e[3] - t0).total_seconds() >= 2_000]
        r.shuffle(some)
        spark.createDataFrame(some, "queue long, job_id long, kind string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    s = spark.readStream.schema("queue long, job_id long, kind string, at timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = jobs.admissions(s, 4).writeStream.format("memory").queryName("saturated").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {g.job_id: (g.admitted, g.active) for g in spark.table("saturated").collect()}
    assert got == want and len({a for a, _ in got.values()}) == 2
