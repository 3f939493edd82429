"""Growing catalogues, ordered lookups under a rate, raw files."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from groundlake.sources.blob_files import BlobFiles
from groundlake.sources.cursor import Catalogue
from groundlake.sources.lookups import Step, asked, looked_up, title_key


def test_a_growing_catalogue(spark, tmp_path):
    """Batch and stream; the stream goes on where it was, after it was started again."""
    state, out, cp = str(tmp_path / "state.json"), str(tmp_path / "out"), str(tmp_path / "cp")
    grow = lambda n: json.dump([{"n": i} for i in range(n)], open(state, "w"))
    spark.dataSource.register(Catalogue)
    options = {"fetcher": "tests.fake_sources:page", "page_size": 4, "sort": state}

    def run():
        s = spark.readStream.format("catalogue").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
        q = s.start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.position, r.record) for r in spark.read.parquet(out).collect())

    grow(10)
    assert spark.read.format("catalogue").options(**options).load().count() == 10
    assert run() == [(i, json.dumps({"n": i})) for i in range(10)]
    grow(17)
    assert run() == [(i, json.dumps({"n": i})) for i in range(17)]
    assert [p for p, _ in run()] == list(range(17))
    grow(0)
    assert spark.read.format("catalogue").options(**options).load().count() == 0


def caller(path, answers):
    def fetch(key):
        with open(path, "a") as f:
            f.write(f"{time.time()} {key}\n")
        if key == "broken":
            raise OSError("late")
        return answers.get(key)

    return fetch


def test_lookups_in_order_and_once(spark, tmp_path):
    heard, cache = str(tmp_path / "heard"), str(tmp_path / "cache")
    rows = spark.createDataFrame([(1, "d1", "T one"), (2, "d2", "T two"), (3, None, "T two"), (4, None, None), (5, "broken", "T five"), (6, "d1", "x"), (7, "d7", "  " + "long " * 40)], "id int, doi string, title string")
    by_doi = Step("doi", F.col("doi"), caller(heard, {"d1": '{"u": 1}', "d2": '{"u": null}'}), lambda r: F.get_json_object(r, "$.u").isNotNull())
    by_title = Step("title", title_key(F.col("title")), caller(heard, {"T two": "t2", "T five": "t5"}))
    want = {1: ("doi", '{"u": 1}'), 2: ("title", "t2"), 3: ("title", "t2"), 4: (None, None), 5: ("title", "t5"), 6: ("doi", '{"u": 1}'), 7: (None, None)}
    ask = lambda df: {r.id: (r.source, r.response) for r in looked_up(df, [by_doi, by_title], cache, rate=200).collect()}
    assert ask(rows) == want
    calls = [x.split(" ", 1)[1].strip() for x in open(heard)]
    assert sorted(calls) == sorted(["d1", "d2", "broken", "d7", "T two", "T five", ("long " * 40)[:120].strip()])
    assert ask(rows) == want
    assert [x.split(" ", 1)[1].strip() for x in open(heard)][len(calls) :] == ["broken"]  # a failure is no miss
    assert looked_up(rows.limit(0), [by_doi], cache).collect() == []


def test_calls_a_second_are_bounded(spark, tmp_path):
    heard = str(tmp_path / "heard")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(24)], "key string")
    assert len(asked(keys, caller(heard, {}), rate=8.0, parallel=4).collect()) == 24
    at = sorted(float(x.split()[0]) for x in open(heard))
    assert len(at) == 24
    for i in range(len(at)):
        assert sum(at[i] <= t < at[i] + 1.0 for t in at) <= 8 + 4  # a second's calls, and one more a task at its edges


def test_raw_files(spark, tmp_path):
    spark.dataSource.register(BlobFiles)
    out = str(tmp_path / "blobs")
    rows = spark.createDataFrame([(f"f{i}.src", bytearray(bytes([i]) * i)) for i in range(9)] + [("none", None)], "name string, content binary").repartition(3)
    rows.write.format("blob_files").mode("append").save(out)
    assert {n: open(f"{out}/{n}", "rb").read() for n in os.listdir(out)} == {f"f{i}.src": bytes([i]) * i for i in range(9)} | {"none": b""}
    bad = rows.withColumn("name", F.when(F.col("name") == "f8.src", "a/b").otherwise(F.concat(F.lit("new-"), "name")))
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("blob_files").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted([f"f{i}.src" for i in range(9)] + ["none"])
    with pytest.raises(Exception, match="one name"):
        rows.withColumn("name", F.lit("same")).write.format("blob_files").mode("append").save(out)
    assert "same" not in os.listdir(out) and not any(n.startswith("_") for n in os.listdir(out))
