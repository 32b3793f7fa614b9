"""Expiring keyed state and restart-safe ingest on small streams of files."""

import datetime as dt
import glob
import os

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wirelake.streaming import events as ev
from wirelake.streaming import ingest, state

DAY = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def at(hour, minute=0):
    return DAY + dt.timedelta(hours=hour, minutes=minute)


def files(spark, path, batches, schema):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{number}")
        for name in glob.glob(f"{path}/in/{number}/*.parquet"):
            os.utime(name, (1_700_000_000 + 10 * number,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


JOB = "job_id long, ts timestamp, seq long, status string, progress long, stage string, artifact string, artifact_value string"


def test_jobs_expire_and_late_rows_are_left_out(spark, tmp_path):
    batches = [
        # the later row arrives first in its batch; an artifact is set twice, the later value stays
        [(1, at(10, 5), 2, "processing", 50, "ocr", "pages", "new"), (1, at(10), 1, "processing", 10, "queued", "pages", "old"), (3, at(10), 3, "completed", 100, "done", None, None)],
        [(2, at(12), 4, "processing", 1, "queued", None, None), (1, at(10, 20), 5, "processing", 70, "ocr", "text", "t")],
        [(1, at(10, 25), 6, "failed", 0, "late", None, None), (1, at(12, 10), 7, "processing", 5, "again", None, None)],
        [(2, at(12, 30), 8, "completed", 100, "done", None, None)],
    ]
    stream = files(spark, str(tmp_path), batches, JOB)
    changes = ev.collect_changes(state.job_states(stream, "1 hour", "20 minutes", "10 minutes"), state.STORE)
    stale = {(r["job_id"], r["ts"].astimezone(dt.timezone.utc)) for r in changes.filter("event = 'stale'").collect()}
    assert stale == {(1, at(10, 20)), (2, at(12))}
    got = {(r["job_id"], r["since"].astimezone(dt.timezone.utc)): r for r in state.last_states(changes, "job_id").collect()}
    assert set(got) == {(1, at(10)), (1, at(12, 10)), (2, at(12)), (3, at(10))}
    first = got[1, at(10)]
    assert (first["event"], first["status"], first["progress"], first["max_progress"], first["updates"], first["artifacts"]) == ("closed", "processing", 70, 70, 3, ["pages=new", "text=t"])
    # the row of 10:25 came when the watermark was at 11:50
    assert got[1, at(12, 10)]["updates"] == 1 and got[1, at(12, 10)]["event"] == "open" and got[3, at(10)]["event"] == "closed"
    assert got[2, at(12)]["status"] == "completed" and got[2, at(12)]["updates"] == 2
    assert ev.progress_view(state.last_states(changes, "job_id")).first()["active"] == 1


def test_profiles_expire(spark, tmp_path):
    schema = "user_id long, ts timestamp, seq long, interaction_type string, target_object_id string, success boolean"
    batches = [
        [(1, at(1, i), i, "select", f"P{i % 3}", i != 2) for i in range(6)],
        [(1, at(2), 10, "undo", "P1", True), (1, at(2, 1), 11, "undo", "P9", True), (2, at(2), 12, None, None, False)],
        [(1, at(9), 13, "select", "P1", True)],
    ]
    changes = ev.collect_changes(state.profile_states(files(spark, str(tmp_path), batches, schema), 2, "3 hours", "10 minutes"), state.STORE)
    got = {(r["user_id"], r["event"]): r for r in state.last_states(changes, "user_id").collect()}
    one = got[1, "closed"]
    assert (one["total"], one["errors"], one["components"], one["kinds"], one["experience_level"]) == (8, 1, 4, ["select=6", "undo=2"], "expert")
    assert got[1, "open"]["total"] == 1 and got[2, "closed"]["kinds"] == [] and got[2, "closed"]["errors"] == 1


ROWS = "id long, ts long, name string, note string"


def batches_of_rows():
    return [
        [(1, 1, "a", None), (2, 1, "b", "x"), (None, 1, "lost", None), (1, 2, "a2", "y")],
        [(2, 5, "b5", None), (3, 1, "c", None)],
        [(2, 4, "b4", "late"), (9, 1, "i", None), (1, 3, "a3", None)],
    ]


def test_ingest_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    part = F.col("id") % 2
    want = {(1, 3, "a3", None), (2, 5, "b5", None), (3, 1, "c", None), (9, 1, "i", None)}
    whole = ingest.ingest_files(files(spark, str(tmp_path / "one"), batches_of_rows(), ROWS), str(tmp_path / "one/table"), str(tmp_path / "one/progress"), ["id"], ["ts"], part)
    assert {tuple(r) for r in whole.collect()} == want
    real, base = ingest.merge_batch, str(tmp_path / "two/table")

    def stops(df, epoch, *more):
        real(df, epoch, *more)
        if epoch == 1:  # as if the job had ended before it wrote the manifest
            for name in glob.glob(f"{base}/manifest/1/*"):
                os.unlink(name)
            raise RuntimeError("stopped")

    monkeypatch.setattr(ingest, "merge_batch", stops)
    source = files(spark, str(tmp_path / "two"), batches_of_rows(), ROWS)
    with pytest.raises(Exception, match="stopped"):
        ingest.ingest_files(source, base, str(tmp_path / "two/progress"), ["id"], ["ts"], part)
    assert {tuple(r) for r in ingest.read_table(spark, base, ROWS).collect()} == {(1, 2, "a2", "y"), (2, 1, "b", "x")}
    monkeypatch.setattr(ingest, "merge_batch", real)
    other = spark.newSession()
    again = other.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "two/in"))
    assert {tuple(r) for r in ingest.ingest_files(again, base, str(tmp_path / "two/progress"), ["id"], ["ts"], part).collect()} == want
    # a batch that comes again changes nothing, and only touched parts have new versions
    before = sorted(glob.glob(f"{base}/**/*.parquet", recursive=True))
    real(spark.createDataFrame([(1, 99, "again", None)], ROWS), 2, base, ["id"], ["ts"], part)
    assert sorted(glob.glob(f"{base}/**/*.parquet", recursive=True)) == before
    assert {r["part"]: r["version"] for r in ingest.manifest(spark, base).collect()} == {"0": 2, "1": 2}
    assert {r["part"]: r["version"] for r in ingest.manifest(spark, base, 1).collect()} == {"0": 0, "1": 0}


@pytest.mark.parametrize("key", ["t04_latest_job_status", "t06_profile_state"])
def test_replay_is_in_order_past_the_end_of_a_month(spark, tmp_path, key):
    start = dt.datetime(2024, 1, 5)
    rows = [(i, start + dt.timedelta(hours=7 * i), i * i % 5, ["click", "view", "purchase", "error"][i % 4], float(i), "{}") for i in range(200)]
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))
    os.unlink(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "all"))
    os.symlink(glob.glob(str(tmp_path / "all/*.parquet"))[0], tmp_path / "events.parquet")
    sql = entry.oracle_sql()[key]
    assert differences(entry.queries()[key](spark, str(tmp_path)), connect(str(tmp_path)), sql) == []
