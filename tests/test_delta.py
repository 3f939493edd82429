"""New papers end to end, their rejects, the PDF rule and the choice of a model."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from groundlake import schemas
from groundlake.operators import delta, encode, index
from groundlake.sources import catalogue

BODY = "\\documentclass{a}\\begin{document}" + "word " * 60 + "\\end{document}"


def paper(paper_id, published="1999-01-01"):
    return (paper_id, "T", ["A"], "", published, published, "hep-th", ["hep-th"], f"u/{paper_id}", None, None, None)


def test_add_papers(spark, tmp_path):
    """A known paper is not asked for, one without a source and one without text are rejects; again nothing comes."""
    path, rejects = str(tmp_path / "index"), str(tmp_path / "rejects")
    vectors = lambda rows: encode.encode(rows, make=lambda: encode.HashingEncoder(4))
    index.build(spark.createDataFrame([("old_000", "1106.4789")], "chunk_id string, paper_id string").join(spark.createDataFrame([], schemas.INDEX).drop("chunk_id", "paper_id"), F.lit(False), "left").select("chunk_id", "paper_id", "title", "year", "primary_category", "chunk_idx", "n_chunks", "text", "embedding"), path)
    papers = spark.createDataFrame([paper("1106.4789"), paper("hep-th/9112056v2"), paper("1401.0001", "2014-01"), paper("1402.0002", "????-01")], schemas.PAPERS)
    blobs = {"hep-th_9112056": BODY.encode(), "1401.0001": b"\\documentclass{a} few"}
    asked = []

    def download(wanted):
        names = [r.safe for r in wanted.collect()]
        asked.extend(names)
        return spark.createDataFrame([(n, bytearray(blobs[n]) if n in blobs else None) for n in names], "safe string, content binary")

    assert delta.add_papers(papers, download, vectors, path, rejects_path=rejects) == {"asked": 3, "failed": 1, "parsed": 2, "empty": 0, "chunks": 1, "rejects": 2, "index": 1, "papers": 1}
    assert sorted(asked) == ["1401.0001", "1402.0002", "hep-th_9112056"]
    rows = index.table(spark, path).filter("paper_id <> '1106.4789'").collect()
    assert [(r.chunk_id, r.paper_id, r.year, len(r.embedding)) for r in rows] == [("hep-th_9112056_000", "hep-th/9112056", "1999", 4)]
    lost = spark.read.schema(schemas.REJECTS).json(rejects)
    assert {(r.paper_id, r.reason) for r in lost.collect()} == {("1401.0001", "not parsed"), ("1402.0002", "no source")}
    assert [r.year for r in delta.shown_rejects(lost, 1).collect()] == ["2014"]
    assert delta.add_papers(papers.filter("paper_id LIKE 'hep%'"), download, vectors, path)["index"] == 0


def test_filter_counts_in_the_same_pass(spark):
    from groundlake.operators import ingest

    rows = [(["A B"], "hep-th"), (["A B"], "math.PR"), (["C"], "hep-th"), (["C"], "math.PR"), ([" A B "], "cond-mat.x")]
    kept, seen = ingest.filtered_counting(spark.createDataFrame(rows, "authors array<string>, primary_category string"), ["A B"])
    assert len(kept.collect()) == 2 and seen.get == {"kept": 2, "skipped_author": 2, "skipped_category": 1}


def test_pdf_rule(spark):
    bodies = {"a": (200, b"\n%PDF" + b"x" * 3000), "b": (200, b"%PDF"), "c": (404, b"%PDF" + b"x" * 3000), "d": (200, b"x" * 30 + b"%PDF" + b"x" * 3000)}
    wanted = spark.createDataFrame([(k, k) for k in "abcde"], "safe string, url string")
    present = spark.createDataFrame([("a", 2000), ("e", 2001)], "safe string, length int")
    got = catalogue.downloads(wanted, present, lambda u: bodies[u], delay=0, beyond=2000, accept=catalogue.pdf_body)
    assert {r.safe: r.ok for r in got.collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_model_path(tmp_path):
    with pytest.raises(FileNotFoundError):
        encode.model_path(str(tmp_path / "none"), str(tmp_path), "hub")
    assert encode.model_path(None, str(tmp_path / "none"), "hub") == encode.model_path(None, str(tmp_path), "hub") == "hub"
    for age, (name, files) in enumerate({"old": ["config.json", "tokenizer.json", "pytorch_model.bin"], "new": ["config.json", "tokenizer.json", "model.safetensors"], "part": ["config.json"]}.items()):
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text("")
        os.utime(tmp_path / name, (age, age))
    assert encode.model_path(None, str(tmp_path), "hub") == str(tmp_path / "new")
    assert encode.model_path(str(tmp_path), "", "hub") == str(tmp_path)
    assert [encode.pick_device(lambda d, s=s: d in s) for s in (("cuda", "mps"), ("cuda",), ())] == ["mps", "cuda", "cpu"]
