"""Health as constraints, the gold file in place, and what the command line picks and shows."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from groundlake import cli, schemas
from groundlake.operators import checks, chunk, encode, index, resolve


def told(df):
    return {r["check"]: (r["status"], r["detail"]) for r in df.collect()}


def test_constraints(spark):
    papers = spark.createDataFrame([("a", "A", "1999"), ("a", "B", "????"), (None, "C", "2001"), ("b", None, None)], "paper_id string, title string, published string")
    assert told(checks.checked(papers, checks.paper_constraints(), (checks.unique("paper_id"),))) == {"paper ids present": ("FAIL", "1 rows, first C"), "metadata years": ("WARN", "2 rows, first a ????"), "paper_id unique": ("FAIL", "4 rows, 1 again")}
    assert set(s for s, _ in told(checks.checked(papers.limit(0), checks.paper_constraints(), (checks.unique("paper_id"),))).values()) == {"OK"}
    chunks = spark.createDataFrame([("c0", 0, 2, [1.0], "t"), ("c1", 2, 2, [], ""), ("c2", 1, 2, None, "t")], "chunk_id string, chunk_idx int, n_chunks int, embedding array<float>, text string")
    assert told(checks.checked(chunks, checks.chunk_constraints())) == {"chunk places": ("FAIL", "1 rows, first c1"), "chunk vectors": ("FAIL", "2 rows, first c1"), "chunk texts": ("WARN", "1 rows, first c1")}


def test_surroundings(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("A_KEY", "x")
    monkeypatch.delenv("B_KEY", raising=False)
    hit = spark.createDataFrame([(1, 0.5, "p")], "rank int, score double, paper_id string")
    got = told(checks.surroundings(spark, paths=(str(tmp_path), str(tmp_path / "none")), modules=("numpy", "no_such_module"), keys=("A_KEY", "B_KEY"), model=lambda: 1 / 0, smoke=lambda: hit))
    assert got[f"exists {tmp_path}"][0] == "OK" and got[f"exists {tmp_path / 'none'}"][0] == "FAIL" and got["runtime imports"] == ("FAIL", "no_such_module")
    assert got["A_KEY"][0] == "OK" and got["B_KEY"][0] == "WARN" and got["model folder"][0] == "FAIL" and got["retrieval"] == ("OK", "1. 0.500 p")


def corpus(spark, path):
    papers = [("1106.4789", "Gauge theory and knots", "2011-06-01", "hep-th", "knots and gauge theory " * 20), ("hep-th/9112056", "Mirror manifolds", "1991-12-01", "hep-th", "mirror manifolds and strings " * 20)]
    chunks = chunk.chunk_papers(spark.createDataFrame(papers, "paper_id string, title string, published string, primary_category string, text string"))
    index.build(encode.encode(chunks), path)


def test_gold_in_place(spark, tmp_path, capsys):
    path, gold = str(tmp_path / "index"), tmp_path / "gold.jsonl"
    corpus(spark, path)
    lines = ['{"qid": "q1",  "question": "é [x]?", "expected_citations": ["Gauge theory and knots (2011)", "zzz"], "notes": "keeps  blanks"}', '{"qid":"q2","question":"none","expected_citations":["1106.4789"]}', '{"qid": "q3", "question": "no list"}']
    gold.write_text("\n".join(lines) + "\n")
    at = ["--index", path, "resolve", "--gold", str(gold), "--in-place"]
    assert cli.main(at) == 0 and "rewritten" in capsys.readouterr().out
    now = gold.read_text().splitlines()
    assert now[1:] == lines[1:] and json.loads(now[0]) == json.loads(lines[0]) | {"expected_citations": ["1106.4789", "zzz"]}
    assert now[0].startswith('{"qid": "q1",  "question": "é [x]?"') and now[0].endswith('"notes": "keeps  blanks"}')
    assert (tmp_path / "gold.jsonl.old").read_text().splitlines() == lines
    stamp = os.stat(gold).st_mtime_ns
    assert cli.main(at) == 0 and "unchanged" in capsys.readouterr().out
    assert os.stat(gold).st_mtime_ns == stamp and not [n for n in os.listdir(tmp_path) if ".new-" in n]
    assert resolve.rewrite_gold(spark, str(gold), resolve.papers_of(index.table(spark, path)), schemas.GOLD) is False


def test_subsets_and_health(spark, tmp_path, capsys):
    path, gold = str(tmp_path / "index"), tmp_path / "gold.jsonl"
    corpus(spark, path)
    gold.write_text("".join(json.dumps({"qid": f"q{i}", "question": "gauge knots", "type": "in_corpus", "expected_citations": []}) + "\n" for i in range(3)))
    assert cli.main(["--index", path, "eval", "--gold", str(gold), "--ids", "q0,q2", "--conditions", "closed_book", "--out", str(tmp_path / "run")]) == 0
    assert sorted((r.qid, r.condition) for r in spark.read.json(str(tmp_path / "run")).collect()) == [("q0", "closed_book"), ("q2", "closed_book")]
    capsys.readouterr()
    assert cli.main(["--index", path, "health"]) == 0
    said = capsys.readouterr().out
    assert "OK   retrieval  1. " in said and "OK   chunk places" in said and "FAIL" not in said
    index.append(spark.createDataFrame([("broken_000", "9999.00001", 5)], "chunk_id string, paper_id string, chunk_idx int").join(index.table(spark, path).limit(0).drop("chunk_id", "paper_id", "chunk_idx"), F.lit(False), "left"), path)
    assert cli.main(["--index", path, "health"]) == 1 and "FAIL chunk vectors" in capsys.readouterr().out
