"""Jobs with timers, joins and sessions as streams: restarts, order, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lifecycle
from tesserae.streaming import jobs, joins

SILENCE = 60


def commands(seed, n=300):
    """In order of time: (document_id, job_type, ts in seconds, seq, action)."""
    draw = random.Random(seed)
    return [(draw.randrange(6), draw.choice(["ocr", "parse"]), 2 * i + 2 * draw.randrange(2), i, draw.choice(["ENSURE", "ENSURE", "START", "START", "BEAT", "COMPLETE", "FAIL", "CANCEL", "other"])) for i in range(n)]


def folded(rows, now):
    """A plain fold of each key."""
    out = []
    for key in sorted({r[:2] for r in rows}):
        held = (0, None, -1)
        for _, _, ts, _, action in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2], r[3])):
            held, events = jobs.step(held, ts * 1000, action, SILENCE * 1000)
            out += [(*key, *e) for e in events]
        out += [(*key, *e) for e in jobs.silenced(held, now * 1000, SILENCE * 1000)[1]]
    return sorted(out, key=repr)


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "document_id long, job_type string, s long, seq long, action string")
    df.select("document_id", "job_type", F.timestamp_seconds("s").alias("ts"), "seq", "action").coalesce(1).write.mode("append").parquet(path)


def events(spark, target):
    return sorted(((r.document_id, r.job_type, r.job_no, r.status, r.ms, r.reason) for r in spark.read.schema(jobs.EVENTS).parquet(target).withColumn("ms", F.unix_millis("at")).collect()), key=repr)


def test_steps_by_hand():
    run = lambda held, ts, action: jobs.step(held, ts, action, 60)
    assert run((0, None, -1), 5, "ENSURE") == ((1, "PENDING", 5), [(1, "PENDING", 5, None)])
    assert run((1, "PENDING", 5), 6, "ENSURE") == ((1, "PENDING", 6), [])  # the active one stays
    assert run((1, "PENDING", 5), 500, "START") == ((1, "RUNNING", 500), [(1, "RUNNING", 500, None)])  # waiting isn't silence
    assert run((1, "RUNNING", 500), 560, "BEAT") == ((1, "RUNNING", 560), [])
    assert run((1, "RUNNING", 500), 561, "BEAT") == ((1, None, 561), [(1, "FAILED", 560, "silence")])
    assert run((1, "RUNNING", 500), 700, "ENSURE") == ((2, "PENDING", 700), [(1, "FAILED", 560, "silence"), (2, "PENDING", 700, None)])
    assert run((1, "PENDING", 5), 6, "COMPLETE") == ((1, None, 6), [(1, "COMPLETED", 6, None)])
    assert run((1, None, 5), 6, "COMPLETE") == run((1, None, 5), 6, "START") == ((1, None, 6), [])


@pytest.fixture
def far_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_jobs_in_another_time_zone(spark, tmp_path, far_zone):
    rows = commands(2, 80)
    write(spark, rows, str(tmp_path / "in"))
    jobs.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), SILENCE).awaitTermination()
    assert events(spark, str(tmp_path / "out")) == folded(rows, max(r[2] for r in rows) - 1)


@pytest.mark.parametrize("cuts", [[300], [100, 200, 300]])
def test_jobs_over_restarts(spark, tmp_path, cuts):
    """The same jobs in one run and in three that go on from the checkpoint; timers fire for keys that no batch names."""
    rows, start = commands(1), 0
    for stop in cuts:
        write(spark, rows[start:stop], str(tmp_path / "in"))
        jobs.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), SILENCE).awaitTermination()
        start = stop
    now = max(r[2] for r in rows) - 1  # odd: no timer falls on the watermark itself
    got = events(spark, str(tmp_path / "out"))
    assert got == folded(rows, now) and any(e[5] == "silence" for e in got)
    found = jobs.jobs(spark.read.schema(jobs.EVENTS).parquet(str(tmp_path / "out")))
    assert lifecycle.contested(found).count() == 0  # at most one active job of a document and type
    write(spark, [(99, "ocr", 10_000, 1000, "ENSURE")], str(tmp_path / "in"))  # moves the watermark past all that runs
    jobs.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), SILENCE).awaitTermination()
    found = jobs.jobs(spark.read.schema(jobs.EVENTS).parquet(str(tmp_path / "out")))
    assert found.where("last_status = 'RUNNING'").count() == 0 and found.where("document_id = 99").count() == 1


def rows_of(spark, folder, *columns):
    return sorted(map(tuple, spark.read.parquet(folder).select(*columns).collect()))


def test_join_drops_late_rows(spark, tmp_path):
    """A state behind its side's watermark is dropped; one beyond the interval never meets; the outer join tells uploads without a state."""

    def put(name, rows):
        time = "uploaded_at" if name == "uploads" else "at"
        df = spark.createDataFrame(rows, f"document_id long, s long{'' if name == 'uploads' else ', state string'}")
        df.withColumn(time, F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def go(how, target):
        up = spark.readStream.schema("document_id long, uploaded_at timestamp").parquet(str(tmp_path / "uploads"))
        st = spark.readStream.schema("document_id long, state string, at timestamp").parquet(str(tmp_path / "states"))
        joins.appended(joins.within(up, st, "100 SECONDS", "10 seconds", how), str(tmp_path / target), str(tmp_path / f"{target}-state")).awaitTermination()

    put("uploads", [(1, 1000), (2, 1000), (3, 1010)])
    put("states", [(1, 1050, "A"), (2, 1101, "too far"), (9, 1000, "no upload")])
    for how, target in (("inner", "in"), ("leftOuter", "out")):
        go(how, target)
    put("uploads", [(4, 3000)])
    put("states", [(4, 3010, "B"), (3, 1020, "late")])
    put("uploads", [(5, 1000)])
    for how, target in (("inner", "in"), ("leftOuter", "out")):
        go(how, target)
    put("uploads", [(6, 9000)])
    put("states", [(7, 9000, "moves both watermarks")])
    for how, target in (("inner", "in"), ("leftOuter", "out")):
        go(how, target)
    got = rows_of(spark, str(tmp_path / "in"), "document_id", "state")
    assert (1, "A") in got and (4, "B") in got and not [s for _, s in got if s in ("too far", "no upload")]
    outer = spark.read.parquet(str(tmp_path / "out"))
    assert {r.document_id for r in outer.where("state IS NULL").collect()} >= {2} and outer.where("document_id = 1").first().state == "A"


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    def put(rows):
        df = spark.createDataFrame(rows, "k string, s long, error boolean")
        df.select("k", F.timestamp_seconds("s").alias("ts"), "error").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        stream = joins.sessions(spark.readStream.schema("k string, ts timestamp, error boolean").parquet(str(tmp_path / "in")), ["k"], "10 seconds", "5 seconds")
        joins.appended(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return rows_of(spark, str(tmp_path / "out"), "k", F.unix_seconds("start"), F.unix_seconds("end"), "n", "n_errors")

    put([("a", 100, False), ("a", 109, True), ("a", 130, False), ("b", 131, False)])
    assert go() == [("a", 100, 119, 2, 1)]
    put([("a", 136, True), ("a", 101, False), ("b", 200, False)])  # 136 joins an open session, 101 is behind the watermark of 126
    assert go() == [("a", 100, 119, 2, 1), ("a", 130, 146, 2, 1), ("b", 131, 141, 1, 0)]
