"""Column functions and operators against the behaviour the inventory states."""

from __future__ import annotations

import gzip
import io
import tarfile
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundlake.functions import citations, ids, text, titles
from groundlake.operators import archive, chunk, encode, evaluate, generate, health, index, ingest, resolve, retrieve
from groundlake.sources import catalogue, readers
from groundlake.streaming.append import append_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, data, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("answer", "cited"),
    [
        ("see [1106.4789], [hep-th/9112056] and [inspire:193975]", ["1106.4789", "hep-th/9112056", "inspire:193975"]),
        ("[cite] [2.7] [outside corpus]", []),
        ("[1106.4789, hep-th/9112056; inspire:7]", ["1106.4789", "hep-th/9112056", "inspire:7"]),
        ("[1106.4789v3] [1106.4789]", ["1106.4789"]),
        ("[HEP-TH/9112056] [[1401.0001]]", ["1401.0001"]),
        ("", []),
    ],
)
def test_extract_citations(spark, answer, cited):
    assert one(spark, citations.extract_citations(F.lit(answer))) == cited


def check(spark, answer, retrieved, expected="none given"):
    arr = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>") if x is not None else F.lit(None).cast("array<string>")
    return one(spark, citations.validation(F.lit(answer), arr(retrieved), None if expected == "none given" else arr(expected)))


def test_validation(spark):
    v = check(spark, "[1106.4789] [9999.1234]", ["1106.4789", "hep-th/9112056v2"])
    assert v.grounding_violation and v.valid_citations == ["1106.4789"] and v.invalid_citations == ["9999.1234"] and not v.uncited
    v = check(spark, "nothing", ["1106.4789"])
    assert v.uncited and not v.grounding_violation
    v = check(spark, "[1106.4789] this is Outside the Corpus", ["1106.4789v4"])
    assert v.marked_outside_corpus and not v.grounding_violation
    v = check(spark, "[1106.4789]", ["1106.4789", "hep-th/9112056"], ["hep-th/9112056"])
    assert v.retrieval_recall == 1.0 and v.expected_citation_recall == 0.0 and v.retrieval_hit
    empty, unknown = check(spark, "x", ["1106.4789"], []), check(spark, "x", ["1106.4789"], None)
    assert empty.expected_ids == [] and empty.retrieval_recall is None and unknown.expected_ids is None


class Scripted:
    name = model = "scripted"

    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def generate(self, system, user, max_tokens=0):
        self.calls.append(user)
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


@pytest.mark.parametrize(("answers", "grounded", "attempts"), [(["ok [1106.4789]"], True, 1), (["[9999.1234]", "ok [1106.4789v2]"], True, 2), (["[9999.1234]"], False, 3), (["I cannot say."], True, 1)])
def test_guardrail(answers, grounded, attempts):
    b = Scripted(*answers)
    _, g, n = generate.generate_grounded(b, "s", "u", ["1106.4789"])
    assert (g, n, len(b.calls)) == (grounded, attempts, attempts)
    assert all(c.startswith("u\n\n") and c.count("9999.1234") == 1 for c in b.calls[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["[1106.4789v2]", "[hep-th/9112056; x]", "[HEP-TH/9112056]", "[[a]", "]", "[inspire:9, 1401.12345]", " "]), max_size=6))
def test_guardrail_matches_columns(parts):
    got = generate.invalid_citations("".join(parts), [])
    want = set()
    joined = "".join(parts)
    for token in ("1106.4789", "hep-th/9112056", "inspire:9", "1401.12345"):
        if token in got:
            want.add(token)
            assert token in joined
    assert set(got) == want


def test_generate_stage_keeps_errors(spark):
    def factory(name):
        if name == "broken":
            raise RuntimeError("no key")
        return generate.Extractive()

    rows = [("q1", "extractive", "rag", "s", "ID: 1106.4789 (2011)\nText:\nwords here\n", ["1106.4789"]), ("q1", "broken", "rag", "s", "u", [])]
    df = spark.createDataFrame(rows, "qid string, backend string, condition string, system string, user string, retrieved_ids array<string>")
    got = {r.backend: r for r in generate.generate(df, factory).collect()}
    assert got["extractive"].grounded and got["extractive"].answer.endswith("[1106.4789]")
    assert got["broken"].error == "RuntimeError: no key" and got["broken"].answer is None
    with pytest.raises(ValueError, match="unknown provider"):
        generate.get_backend("nobody")


def windows(words, size=450, overlap=60):
    out, at = [], 0
    while words:
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 449, 450, 451, 840, 841, 1230, 1231])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    assert one(spark, chunk.chunk_text(F.lit("\n ".join(words)))) == windows(words)


def test_chunk_ids(spark):
    row = [("hep-th/9112056v2", "t", "1991-12-01", "hep-th", " ".join(["x"] * 60))]
    got = chunk.chunk_papers(spark.createDataFrame(row, "paper_id string, title string, published string, primary_category string, text string")).first()
    assert (got.chunk_id, got.paper_id, got.year, got.n_chunks) == ("hep-th_9112056_000", "hep-th/9112056", "1991", 1)
    assert one(spark, ids.chunk_id(F.lit("a:b/c"), F.lit(1234))) == "a_b_c_1234"


def test_ids(spark):
    assert values(spark, ["HEP-TH/9112056V2 ", "1106.4789v12"], ids.normalize_id) == ["hep-th/9112056", "1106.4789"]
    assert values(spark, ["1999", "1999\n", "????", "207", None], ids.valid_year) == [True, False, False, False, False]
    assert values(spark, ["hep-th/9407087", "1401.8048", "0706.1234", "inspire:1"], ids.year_from_id) == ["1994", "2014", "2007", None]
    assert values(spark, ["hep-th", "cond-mat.str-el", "math.AG", "math.PR", "stat.ML"], ids.category_ok) == [True, True, True, False, False]
    assert values(spark, ["math/9112056", "math.AG/9112056v2", "inspire:12", "12.1", "1106.4789\n"], ids.is_paper_id) == [True, True, True, False, True]
    assert values(spark, ["0700123", "9912345", "123"], titles.year_from_filename) == ["2007", "1999", ""]


def test_text(spark):
    assert one(spark, text.latex_strip(F.lit("a 5\\% b % c\rd\ne"))) == "a 5\\% b \ne"
    assert one(spark, text.latex_strip(F.lit("x\\begin{document}y\\end{document}z"))) == "y"
    assert one(spark, text.latex_strip(F.lit("x\\begin{document}y"))) == "y"
    assert one(spark, text.pdf_cleanup(F.lit("hy-\nphen -\né  x\n\n\n\ny\t"))) == "hyphen é x\n\ny"
    assert one(spark, text.text_cleanup(F.lit(" [NO \\author GIVEN]a \t b<cit.>\n\n\n\nc "))) == "a b[cite]\n\nc"


def test_cells_round_the_stored_value(spark):
    """As printf and Python do; 0.145 is stored as less, and exact halves go to even."""
    from groundlake.functions import prompts

    data = [0.145, 0.125, 0.375, 0.005, 0.015, 1.005, 2.675, 0.625, 1234.565, 0.0, 1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v double")
    got = [r.x for r in df.select("i", prompts.cell(F.col("v"), True).alias("x")).orderBy("i").collect()]
    assert got == ["—" if v is None else f"{v:.2f}" for v in data]


def test_titles(spark):
    assert one(spark, titles.normalize_title(F.lit("The \\alpha{X}--Model (II)"))) == "the alpha x model ii"
    split = values(spark, ["A title (1994)", "1984 and 1999 x", "2001 A", "none", "T (verify) 1990"], titles.split_year)
    assert [(s.title, s.year) for s in split] == [("A title", "1994"), ("1984 and  x", "1999"), ("A", "2001"), ("none", None), ("T", "1990")]
    assert [one(spark, titles.band(F.lit(x))) for x in (0.900, 0.899, 0.600, 0.599)] == ["confident", "review", "review", "none"]
    assert one(spark, titles.pii_dois(F.lit("0550321376901115"))) == ["10.1016/0550-3213(76)90111-5", "10.1016/0550321376901115", "10.1006/0550321376901115"]
    assert one(spark, titles.pii_dois(F.lit("123"))) == ["10.1016/123", "10.1006/123"]


def test_resolve(spark):
    papers = spark.createDataFrame([("a", "Gauge theory and knots", "1989", 0), ("a", "Second", "1989", 1), ("b", "Gauge theory of knots", "1991", 0), ("c", "Else", "", 0)], "paper_id string, title string, year string, chunk_idx int")
    known = resolve.papers_of(papers)
    asked = spark.createDataFrame([("0", "gauge theory and knots (1989)")], "qid string, query string")
    got = resolve.resolve(asked, known).orderBy("rank").collect()
    assert [r.paper_id for r in got][:2] == ["a", "b"] and got[0].score == 1.0 and got[0].band == "confident"
    ratio = SequenceMatcher(None, "gauge theory and knots", "gauge theory of knots").ratio()
    assert got[1].score == round(ratio - 0.05, 3)
    gold = spark.createDataFrame([("q", ["Gauge theory and knots (1989)", "1106.4789", "zzz"])], "qid string, expected_citations array<string>")
    assert resolve.resolve_expected(gold, known).first().expected_citations == ["a", "1106.4789", "zzz"]


def tar_gz(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archives(spark):
    both = tar_gz({"longer.tex": b"\\documentclass{x}", "a.tex": b"\\section{s}", "b.tex": b"\\documentclass{y}", "fig.png": b"0"})
    assert [n for n, _ in archive.latex_files(both)] == ["longer.tex", "a.tex", "b.tex"]
    assert archive.latex_files(gzip.compress(b"\\section{q}")) == [("main.tex", "\\section{q}")]
    assert archive.latex_files(b"\\def\\x{}")[0][0] == "main.tex"
    assert archive.latex_files(b"%PDF-1.4 binary") == [] == archive.latex_files(None)
    df = spark.createDataFrame([(bytearray(both),)], "content binary")
    assert df.select(archive.main_file(archive.extract("content")).alias("m")).first().m == "\\documentclass{y}"
    pdfs = spark.createDataFrame([(bytearray(b"one two"),), (bytearray(b"x " * 60),)], "content binary")
    got = archive.pdf_text(pdfs, [("broken", lambda b: 1 / 0, 1), ("plain", lambda b: b.decode(), 50)]).collect()
    assert sorted(r.method for r in got) == ["failed", "plain"]
    assert one(spark, archive.latex_to_text(F.lit("\\begin{document}\\emph{hi} $x^2$ \\cite{a}\\end{document}"))) == "hi $x^2$ [cite]"


def test_delta_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("c1", "p1"), ("c2", "p2")], "chunk_id string, paper_id string")
    index.build(rows, path)
    more = spark.createDataFrame([("c2", "p2"), ("c3", "p3")], "chunk_id string, paper_id string")
    index.append(more, path)
    index.append(more, path)
    assert index.table(spark, path).count() == 3
    incoming = str(tmp_path / "in")
    spark.createDataFrame([("c4", "p4"), ("c3", "p3")], "chunk_id string, paper_id string").write.parquet(incoming)
    append_stream(spark, incoming, path, str(tmp_path / "cp"), "chunk_id string, paper_id string").awaitTermination()
    assert index.table(spark, path).count() == 4


def test_export(spark, tmp_path):
    rows = [("c1", "1106.4789", [0.6, 0.8]), ("c2", "inspire:1", [1.0, 0.0]), ("c3", "1106.4789", [0.0, 1.0])]
    table = spark.createDataFrame(rows, "chunk_id string, paper_id string, embedding array<float>")
    m = index.export_public(table, str(tmp_path))
    assert (m["public_export"], m["excluded"]["vectors"]) == ({"vectors": 2, "papers": 1, "dim": 2}, 1)
    assert m["source_index"]["vectors"] == 3 and all(len(h) == 64 for h in m["artifacts"].values())


def test_retrieval_bounds(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, q_embedding array<float>")
    for fn in (retrieve.top_k, lambda *a, **b: retrieve.top_k(*a, **b, most=1)):
        assert [(r.chunk_id, r["rank"]) for r in fn(table, q, 99).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert [r.chunk_id for r in retrieve.top_k_single(table, [1.0, 0.0], 2).collect()] == ["a", "b"]


def test_scores_held_are_bounded():
    """A batch against many questions never has all its scores at once, and finds what all scores give."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(6000, 4)), rng.normal(size=(2000, 4))
    held = retrieve.Nearest(q, 3)
    tracemalloc.start()
    for start in range(0, 6000, 3000):
        held.add(np.arange(start, start + 3000), x[start : start + 3000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all scores of a batch: 48 MB, and as much to part them
    assert (held.ids.reshape(2000, 3) == np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :3]).all()


def test_blocks_of_questions_share_a_pass(spark):
    """The index is read, and questions fetched, as often for many blocks as for one."""
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "qid int, q_embedding array<double>")
    sc, jobs, found = spark.sparkContext, [], []
    for most in (12, 1):
        sc.setJobGroup(f"blocks-{most}", "")
        found.append(sorted(retrieve.top_k(table, q, 3, most=most).collect()))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"blocks-{most}")))
    sc._jsc.clearJobGroup()
    assert jobs[0] == jobs[1] and found[0] == found[1] and len(found[0]) == 36


def test_encoder(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    got = [r.embedding for r in encode.encode(df, make=lambda: encode.HashingEncoder(16)).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6) and sum(map(abs, got[1])) == 0


def test_encoder_hashes_every_word():
    """Words after the 512th count; a limit holds only where it is stated."""
    long = "a " * 512
    whole, cut = encode.HashingEncoder(16).encode([long, long + "b " * 400]), encode.HashingEncoder(16, max_words=512).encode([long, long + "b " * 400])
    assert not np.allclose(whole[0], whole[1]) and np.allclose(cut[0], cut[1])


def test_resolve_titles_asks_every_fiftieth(spark, sf_dir):
    from groundlake.plans.queries import QUERIES

    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 50 = 0").select(F.col("doc_id").cast("string")).collect()
    assert {r.qid for r in QUERIES["resolve_titles"](spark, sf_dir).select("qid").distinct().collect()} == {r[0] for r in asked}


def test_identify(spark):
    files = spark.createDataFrame([("0033151", ""), ("8712296", ""), ("BF01", ""), ("zzz", "% c\nA fitting title line\n")], "stem string, text string")
    known = spark.createDataFrame([("recid", "33151", "33151", None), ("report", "87-12-296", "5", "hep-th/9112056"), ("title", "A fitting title line", "9", None)], "kind string, key string, recid string, eprint string")
    got = {r.stem: (r.paper_id, r.canonical) for r in ingest.identify(files, known).collect()}
    assert got == {"0033151": ("inspire:33151", "inspire:33151"), "8712296": ("hep-th/9112056", "inspire:5"), "BF01": (None, None), "zzz": ("inspire:9", "title:A fitting title line")}


def test_catalogue(spark):
    spark.dataSource.register(catalogue.Pages)
    df = spark.read.format("catalogue_pages").options(total=5, page_size=2, fetcher="tests.test_functions:fake_page").load()
    assert sorted((r.page, r.record) for r in df.collect()) == [(0, '{"n": 0}'), (0, '{"n": 1}'), (1, '{"n": 2}'), (1, '{"n": 3}'), (2, '{"n": 4}')]
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    got = {r.key: r.response for r in catalogue.fetched(keys, lambda k: {"a": '{"openAccessPdf": {"url": "u"}}'}[k], delay=0).collect()}
    assert got["b"] is None and one(spark, catalogue.open_access_url(F.lit(got["a"]))) == "u"
    assert one(spark, catalogue.open_access_url(F.lit('{"data": [{"title": "x"}, {"openAccessPdf": {"url": "v"}}]}'))) == "v"
    raw = '{"recid": "7", "titles": [{"title": " T "}], "authors": [{"full_name": "A"}, {}], "publication_info": []}'
    rec = spark.createDataFrame([(raw,)], "j string").select(F.from_json("j", __import__("groundlake.schemas").schemas.CATALOGUE).alias("r")).select("r.*")
    row = ingest.catalogue_rows(rec).first()
    assert (row.paper_id, row.title, row.authors, row.published, row.primary_category) == ("inspire:7", "T", ["A", ""], "????-01-01T00:00:00", "hep-th")


def fake_page(page, size):
    return [{"n": i} for i in range(page * size, min(5, page * size + size))]


def test_filters_keep_every_row(spark):
    rows = [([" Ann Author "], "hep-th"), (["X"], "hep-th"), (["Ann Author"], "stat.ML"), (None, "hep-th")]
    df = spark.createDataFrame(rows, "authors array<string>, primary_category string")
    kept, counts = ingest.filtered(df, ["Ann Author"])
    assert kept.count() == 1 and dict(map(tuple, counts.collect())) == {"kept": 1, "skipped_author": 2, "skipped_category": 1}


def test_health(spark):
    papers = spark.createDataFrame([("a", "t", "1999-01-01"), ("a", "u", "????-01")], "paper_id string, title string, published string")
    got = {r.check: r.status for r in health.health(spark, papers, papers, papers).collect()}
    assert got == {"index/chunk counts": "OK", "metadata ids unique": "FAIL", "metadata years": "WARN", "runtime imports": "OK"}


def test_mean_rounds(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 0.5)], "a double, b double")
    assert df.agg(evaluate.mean(F.col("a")).alias("x"), evaluate.mean(F.col("b")).alias("y")).first()[:] == (None, 0.75)


def test_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1106.4789\n\n  hep-th/9112056 \n")
    assert [r.paper_id for r in readers.work_list(spark, str(tmp_path / "ids.txt")).collect()] == ["1106.4789", "hep-th/9112056"]
    (tmp_path / "a.jsonl").write_text('{"paper_id": "x"}\n\nbroken\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "paper_id string").collect()
    assert [r.paper_id for r in got] == ["x", None] and got[1]["_corrupt_record"] == "broken"
    (tmp_path / "inspire_1.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"%PDF" + b"x" * 3000)
    pdfs = readers.pdf_blobs(spark, str(tmp_path))
    assert [r.stem for r in pdfs.collect()] == ["b"] and pdfs.select(archive.is_pdf(F.col("content")).alias("x")).first().x


def test_evaluation_run(spark, tmp_path, capsys):
    """Build, ask and evaluate through the command line with the offline defaults."""
    from groundlake import cli

    papers = [("1106.4789v2", "Knots", "2011-06-01", "hep-th", "knots and gauge theory " * 20), ("hep-th/9112056", "Mirrors", "1991-12-01", "hep-th", "mirror manifolds and strings " * 20)]
    chunks = chunk.chunk_papers(spark.createDataFrame(papers, "paper_id string, title string, published string, primary_category string, text string"))
    index.build(encode.encode(chunks), str(tmp_path / "index"))
    gold = tmp_path / "gold.jsonl"
    gold.write_text('{"qid": "q1", "question": "gauge knots", "type": "in_corpus", "expected_citations": ["1106.4789"]}\n{"qid": "q2", "question": "weather", "type": "out_of_corpus", "expected_citations": []}\n')
    at = ["--index", str(tmp_path / "index")]
    assert cli.main([*at, "eval", "--gold", str(gold), "--baseline", "-k", "1", "--out", str(tmp_path / "run")]) == 0
    said = capsys.readouterr().out
    assert "| extractive·rag |" in said and "| extractive·closed_book |" in said and "nothing flagged" in said
    rows = {(r.qid, r.condition): r for r in spark.read.json(str(tmp_path / "run")).collect()}
    assert len(rows) == 4 and rows["q1", "rag"].auto.retrieval_recall == 1.0 and rows["q1", "rag"].answer.endswith("[1106.4789]")
    assert cli.main([*at, "eval", "--gold", str(gold), "--retrieve-only"]) == 0
    assert "mean recall 1.0" in capsys.readouterr().out
    assert cli.main([*at, "ask", "mirror strings", "-k", "1", "--show-passages", "--guardrail"]) == 0
    assert "[hep-th/9112056]" in capsys.readouterr().out
    assert cli.main([*at, "resolve", "Knots (2011)"]) == 0
    assert "confident" in capsys.readouterr().out
    assert cli.main([*at, "health"]) == 0


def test_resolve_matches_all_pairs(spark):
    """The bound leaves out no pair that matching every pair would rank."""
    import random
    from difflib import SequenceMatcher

    from groundlake.operators import resolve

    rng = random.Random(3)
    words = ["gauge", "theory", "mirror", "string", "duality", "of", "the", "knots", "quantum", "field"]
    known = [(f"p{i:03d}", " ".join(rng.choices(words, k=rng.randint(1, 7))), rng.choice(["1990", "2001", "", None])) for i in range(150)]
    known += [("p900", "", "1990"), ("p901", known[0][1], known[0][2])]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 6))) + rng.choice(["", " (1990)", " (2001)"])) for i in range(40)] + [("none", "")]
    papers = spark.createDataFrame([(*k, k[1]) for k in known], "paper_id string, title string, year string, norm string").repartition(3)
    got = {(r.qid, r["rank"]): (r.paper_id, r.score) for r in resolve.resolve(spark.createDataFrame(asked, "qid string, query string"), papers).collect()}
    for qid, query in asked:
        title, year = (query[:-7], query[-5:-1]) if query.endswith(")") else (query, None)
        nudge = lambda y: 0.0 if not (year and y) else 0.05 if y == year else -0.05
        ranked = sorted((-min(SequenceMatcher(None, title, t).ratio() + nudge(y), 1.0), p) for p, t, y in known)[:3]
        for place, (score, paper) in enumerate(ranked, 1):
            assert got[qid, place][0] == paper and abs(got[qid, place][1] + score) < 0.0006


def test_similarities_are_the_matchers():
    """Pairs matched many at a time score as one by one: repeats, empty, long and other texts."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(8)
    parts = ["the", "of", "tion", "en", "a", "", "7", "1989", "aaaa"]
    title = lambda: " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30)))[: rng.choice([0, 5, 60, 199, 230])]
    a, b = [title() for _ in range(3000)] + ["ß", "a" * 700], [title() for _ in range(3000)] + ["ß a", "a" * 30]
    assert resolve.similarities(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


def test_resolve_spreads_its_blocks(spark):
    """Blocks are few bytes and much work: partitions of few bytes, made one, would leave one core busy."""
    words = ["gauge", "theory", "mirror", "string", "duality", "knots"]
    known = spark.createDataFrame([(f"p{i:03d}", t, "1990", t) for i in range(300) for t in [f"{words[i % 6]} {words[i % 5]} {i}"]], "paper_id string, title string, year string, norm string")
    asked = spark.createDataFrame([(f"q{i}", f"{words[i % 4]} {words[i % 3]} {i}") for i in range(20)], "qid string, query string")
    sc = spark.sparkContext
    sc.setJobGroup("spread", "")
    resolve.resolve(asked, known).collect()
    infos = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("spread") for s in sc.statusTracker().getJobInfo(j).stageIds]
    sc._jsc.clearJobGroup()
    assert max(i.numCompletedTasks for i in infos if i) >= 2 * 8


def test_common_subsequences_and_bounds():
    """Bit vectors over one and several words against dynamic programming; never under the blocks matched."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for size, letters in ((0, "ab"), (1, "ab"), (63, "abc "), (64, "ab"), (65, "abcdefgh 01"), (130, "abcd"), (200, "abcdefghij ")):
        q = text(size, letters)
        many = [text(rng.randrange(90), letters) for _ in range(30)] + ["", q, q[:40], q[3:] + q[:3]]
        got = resolve.common_subsequences(q, many)
        assert got.tolist() == [plain(q, x) for x in many]
        for x, n in zip(many, got):
            assert sum(b.size for b in SequenceMatcher(None, q, x).get_matching_blocks()) <= n


def test_resolve_long_titles_copies_and_ties(spark):
    """Titles of all lengths, one borne by a third of the papers, whatever the blocks and seeds."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "x", "y2", "of"]
    known = [(f"p{i:03d}", " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 9, 30, 70]))), rng.choice(["1990", "", None])) for i in range(120)]
    known += [(f"c{i:03d}", "the common title", "1990") for i in range(60)]
    asked = [("a", "the common title"), ("b", "the common titles (1990)"), ("c", known[0][1]), ("d", known[7][1] + " alpha"), ("e", "zzz"), ("f", None), ("g", " ".join(words * 12))]
    papers = spark.createDataFrame([(*k, k[1]) for k in known], "paper_id string, title string, year string, norm string").repartition(4)
    got = {(r.qid, r["rank"]): (r.paper_id, r.score) for r in resolve.resolve(spark.createDataFrame(asked, "qid string, query string"), papers).collect()}
    for qid, query in asked:
        title, year = (query[:-7], query[-5:-1]) if query and query.endswith(")") else (query or "", None)
        nudge = lambda y: 0.0 if not (year and y) else 0.05 if y == year else -0.05
        ranked = sorted((-min(SequenceMatcher(None, title, t).ratio() + nudge(y), 1.0), p) for p, t, y in known)[:3]
        assert [got[qid, k][0] for k in (1, 2, 3)] == [p for _, p in ranked], qid
    high = resolve.resolve(spark.createDataFrame(asked, "qid string, query string"), papers, 1, least=0.9)
    assert {r.qid: r.paper_id for r in high.filter("score >= 0.9").collect()} == {q: p for (q, k), (p, s) in got.items() if k == 1 and s >= 0.9}


def test_resolver_compares_by_blocks(spark, sf_dir):
    """No cross join, and no pair but of a title and a block whose lengths can reach its score."""
    from groundlake.plans.queries import QUERIES

    plan = QUERIES["resolve_titles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan and "FlatMapCoGroups" in plan
    few = resolve.meet(pd.DataFrame({"norm": ["abc", "abd", "xyz"], "year": [None] * 3, "n": [1, 1, 1]}), pd.DataFrame({"qid": ["q"], "q_norm": ["abc"], "q_year": [None], "least": [0.6]}), 3)
    assert few["at"].tolist() == [0, 1]


def test_resolve_in_rounds(spark, monkeypatch):
    """Rounds over growing samples, by few titles a round, rank what all pairs would; years of one title and copies included."""
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(resolve, "FEWEST", 3)
    monkeypatch.setattr(resolve, "ROUND", 4)
    rng = random.Random(12)
    words = ["gauge", "theory", "mirror", "string", "duality", "of", "the", "knots"]
    names = [" ".join(rng.choices(words, k=rng.choice([1, 3, 6, 12, 40]))) for _ in range(50)]
    known = [(f"p{i:03d}", rng.choice(names), rng.choice(["1990", "2001", "????", "", None])) for i in range(160)]
    asked = [(f"q{i}", (rng.choice(names) + rng.choice(["", " knot"])) + rng.choice(["", " (1990)", " (2001)", " (????)"])) for i in range(40)]
    papers = spark.createDataFrame([(*k, k[1]) for k in known], "paper_id string, title string, year string, norm string").repartition(3)
    got = {(r.qid, r["rank"]): r.paper_id for r in resolve.resolve(spark.createDataFrame(asked, "qid string, query string"), papers).collect()}
    assert len(got) == 3 * len(asked)
    for qid, query in asked:
        title, year = (query[:-7], query[-5:-1]) if query.endswith(")") else (query, None)
        year = None if year == "????" else year
        nudge = lambda y: 0.0 if not (year and y) else 0.05 if y == year else -0.05
        ranked = sorted((-min(SequenceMatcher(None, title, t).ratio() + nudge(y), 1.0), p) for p, t, y in known)[:3]
        assert [got[qid, k] for k in (1, 2, 3)] == [p for _, p in ranked], qid


def test_equal_titles_are_matched_once(monkeypatch):
    """A title of many years, asked for with many years, is one pair to match; few others are matched at all."""
    import random

    pairs, plain = [], resolve.similarities
    monkeypatch.setattr(resolve, "similarities", lambda a, b, *more: pairs.extend(zip(a, b)) or plain(a, b, *more))
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefg hijkl", k=30)).strip() for _ in range(400)]
    years = [str(y) for y in range(1976, 2026)]
    titles = pd.DataFrame([(t, y, 1) for t in names for y in years], columns=["norm", "year", "n"])
    asked = pd.DataFrame([(f"{i}-{y}", names[i], y, 0.9) for i in range(5) for y in years], columns=["qid", "q_norm", "q_year", "least"])
    got = resolve.meet(titles, asked, 3)
    best = got.sort_values("s", ascending=False).groupby("qid").first()
    assert len(pairs) == len(set(pairs)) and len(pairs) < 5 * 400 / 10
    assert best["s"].eq(1.0).all() and all(f"{names.index(titles['norm'][a])}-{titles['year'][a]}" == q for q, a in best["at"].items())


def test_similarities_that_fall_short_are_left():
    """With a least value, pairs that reach it score as the matcher does, the others anything under it."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(10)
    parts = ["the", "of", "tion", "en", "a", "7", "1989", "aaaa"]
    title = lambda: " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 25)))[: rng.choice([5, 60, 150, 199])]
    a, b = [title() for _ in range(2000)], [title() for _ in range(2000)]
    least = np.array([rng.choice([0.0, 0.3, 0.5, 0.7, 1.0]) for _ in a])
    true = np.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
    least[::7] = true[::7]
    got = resolve.similarities(a, b, least)
    assert (got == true)[true >= least].all() and (got < least)[true < least].all()
