"""Streams give the answers of the batch operators, whatever the micro-batches."""

import datetime
import random

import pytest

from quillspark.operators.guard import first_trigger
from quillspark.streaming import guard, progress, runs

STEP = "gen_id long, step long, token long, ms double, aborted boolean, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def streams(seed, n):
    r = random.Random(seed)
    out = []
    for g in range(n):
        length, period = r.choice([1, 2, 5, 30, 70]), r.randint(1, 18)
        loop, slow, stop = r.randint(0, length), r.choice([None, r.randint(1, length)]), r.choice([None, None, r.randint(1, length)])
        for k in range(1, length + 1):
            token = k % period if k > loop else 1000 + r.randint(0, 9)
            out.append((g, k, token, 5000.0 if slow and k >= slow else 10.0, stop is not None and k >= stop, START + datetime.timedelta(seconds=k)))
    return out


@pytest.mark.parametrize("files", [1, 7])
def test_one_answer_for_each_stream(spark, tmp_path, files):
    spark.conf.set(*guard.PROVIDER)
    rows = streams(files, 40)
    want = sorted((tuple(x) for x in first_trigger(spark.createDataFrame(rows, STEP), 1000, 60).collect()), key=repr)
    assert {x[2] for x in want} == {None, "aborted", "timeout", "repetition", "max_tokens"}
    random.Random(9).shuffle(rows)
    parts = [rows[k::files] for k in range(files)]
    parts[-1] += parts[0][:20]  # repeated steps
    for k, part in enumerate(parts):
        spark.createDataFrame(part, STEP).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    spark.createDataFrame([(-1, 1, 0, 0.0, True, START + datetime.timedelta(days=9))], STEP).coalesce(1).write.parquet(str(tmp_path / "in/z"))
    steps = spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = runs.finished(guard.online_triggers(steps, 1000, 60, late="1 day"), "guard").where("gen_id >= 0")
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_a_gap_and_an_empty_stream(spark, tmp_path):
    spark.conf.set(*guard.PROVIDER)
    at = lambda k: START + datetime.timedelta(seconds=k)
    rows = [(1, k, k, 1.0, k == 9, at(k)) for k in (1, 2, 4, 9, 11)] + [(2, k, k, 1.0, False, at(k)) for k in (2, 3)] + [(-1, 1, 0, 0.0, True, at(10**6))]
    spark.createDataFrame(rows, STEP).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = runs.finished(guard.online_triggers(spark.readStream.schema(STEP).parquet(str(tmp_path / "in")), 1000, 60), "guard")
    assert sorted(tuple(x) for x in got.where("gen_id >= 0").collect()) == [(1, 9, "aborted"), (2, 2, None)]
    spark.createDataFrame([], STEP).coalesce(1).write.parquet(str(tmp_path / "none"))
    assert runs.finished(guard.online_triggers(spark.readStream.schema(STEP).parquet(str(tmp_path / "none")), 1000, 60), "guard").collect() == []


def test_late_pages_are_left_out_of_progress(spark, tmp_path):
    schema = "doc_id long, ts timestamp, ms double"
    at = lambda m: START + datetime.timedelta(minutes=m)
    for k, part in enumerate(([(1, at(0), 5.0), (1, at(0.5), 7.0), (2, at(1), 3.0)], [(1, at(60), 1.0)], [(1, at(61), 2.0)], [(1, at(0.2), 99.0), (1, at(120), 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    d = progress.page_progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")))
    got = sorted((r.doc_id, r.window.start, r.pages, r.mean_ms, r.worst_ms) for r in runs.finished(d, "progress").collect())
    assert got == [(1, at(0), 2, 6.0, 7.0), (1, at(60), 1, 1.0, 1.0), (1, at(61), 1, 2.0, 2.0), (2, at(1), 1, 3.0, 3.0)]
