"""One query per operator of the inventory over the driver tables (keys as in the build plan)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations, ids, prompts, text, titles, vectors
from ..operators import archive, checks, chunk, clustered, delta, encode, evaluate, generate, health, index, ingest, resolve, retrieve
from ..sources import catalogue
from ..storage import shared_dir
from .inputs import answers, papers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _vectors(spark, sf):
    """Declared columns: no job to look them up in the files."""
    return spark.read.schema("vec_id long, embedding array<float>").parquet(f"{sf}/embeddings.parquet")


def _questions(spark, sf):
    """Every vector whose id is divisible by 50: the stated question set."""
    return _vectors(spark, sf).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_embedding"))


def _hits(spark, sf):
    return retrieve.top_k(_vectors(spark, sf), _questions(spark, sf), 8, id_col="vec_id")


def _passages(spark, sf):
    """Hits with the papers that stand for their passages."""
    p = papers(spark, sf)
    n = p.count()
    joined = _hits(spark, sf).withColumn("doc_id", F.col("vec_id") % n).join(p, "doc_id")
    return joined.withColumn("year", ids.year_of(F.col("published")))


@query
def topk_single(spark, sf):
    v = _vectors(spark, sf)
    q = v.filter("vec_id = 0").first()["embedding"]
    return retrieve.top_k_single(v, q, 8, id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query
def topk_batch(spark, sf):
    return _hits(spark, sf).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def topk_pruned(spark, sf):
    """The batch over a clustered index, built anew."""
    path = f"{shared_dir(spark)}/groundlake/clustered-{uuid.uuid4().hex}"
    clustered.build(_vectors(spark, sf), path, file_rows=512, id_col="vec_id")
    hits, _ = clustered.search(spark, path, _questions(spark, sf), 8, id_col="vec_id")
    return hits.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def topk_blocked(spark, sf):
    done = retrieve.top_k(_vectors(spark, sf), _questions(spark, sf), 8, id_col="vec_id", most=25)
    return done.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def retrieve_join(spark, sf):
    return _passages(spark, sf).select("qid", "rank", "vec_id", "doc_id", "paper_id", F.round("score", 6).alias("score"), text.snippet(F.col("text")).alias("snippet"))


@query
def vec_normalize(spark, sf):
    unit = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)))
    return _vectors(spark, sf).withColumn("u", unit).select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(vectors.inner_product(F.col("u"), F.col("u")), 6).alias("norm2"))


@query
def embed_hash(spark, sf):
    e = encode.encode(table(spark, sf, "documents").select("doc_id", "text"), make=lambda: encode.HashingEncoder(64))
    v = F.col("embedding")
    signs = F.array_join(F.transform(v, lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "")
    largest = (F.array_position(v, F.array_max(v)) - 1).alias("largest")
    return e.select("doc_id", F.size(v).alias("dim"), F.round(vectors.inner_product(v, v), 4).alias("norm2"), largest, F.md5(signs).alias("signs"))


@query
def chunk_rows(spark, sf):
    return chunk.chunk_papers(papers(spark, sf), least_words=1).drop("title")


@query
def filter_min_words(spark, sf):
    return table(spark, sf, "documents").filter(text.enough_words(F.col("text"))).select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_words"))


@query
def text_cleanup(spark, sf):
    raw = F.concat(F.lit(" \t[NO \\title GIVEN] <cit.>"), F.regexp_replace("html", ">", ">\t \n\n\n"), F.lit(" \n"))
    return table(spark, sf, "pages").select("page_id", text.text_cleanup(raw).alias("clean"))


@query
def pdf_cleanup(spark, sf):
    raw = F.concat(F.lit(" \n"), F.regexp_replace("html", "e", "e-\nx  \n\n\n\n"))
    return table(spark, sf, "pages").select("page_id", text.pdf_cleanup(raw).alias("clean"))


@query
def latex_strip(spark, sf):
    i = F.col("page_id").cast("string")
    raw = F.concat(
        F.lit("\\documentclass{a} pre % c\n\\begin{document}\n5\\% of % gone\n\\input{x}\\begin{figure*}a\nb\\end{figure*} t \\begin{table}q\\end{table}\\include{y}"),
        F.col("url"), i, F.col("html"), F.lit("\\bibliographystyle{p}\\bibliography{refs}\\begin{thebibliography}{9}\nz\n\\end{thebibliography} end"), F.when(F.col("page_id") % 2 == 0, "\\end{document} after").otherwise(""),
    )
    return table(spark, sf, "pages").select("page_id", text.latex_strip(raw).alias("body"), text.looks_like_latex(raw).alias("is_latex"))


@query
def snippet(spark, sf):
    p = papers(spark, sf)
    s = text.snippet(F.col("text"))
    return p.select("doc_id", prompts.hit_line(F.lit(1), F.lit(0.5), F.col("paper_id"), ids.year_of(F.col("published")), F.col("source"), s).alias("line"))


@query
def id_normalize(spark, sf):
    raw = F.concat(F.lit(" "), F.upper("paper_id"), F.lit("V"), (F.col("doc_id") % 9).cast("string"), F.lit("\t"))
    return papers(spark, sf).select("doc_id", ids.normalize_id(raw).alias("canonical"), ids.strip_version(F.concat("paper_id", F.lit("v2"))).alias("bare"), ids.safe_name(F.col("paper_id")).alias("safe"))


@query
def id_shape(spark, sf):
    token = F.when(F.col("doc_id") % 4 == 0, F.upper("paper_id")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" "), F.col("paper_id"), F.lit("v3 "))).when(F.col("doc_id") % 4 == 2, F.concat("paper_id", F.lit("x"))).otherwise(F.col("paper_id"))
    return papers(spark, sf).select("doc_id", ids.is_paper_id(token).alias("is_id"), ids.is_public(F.col("paper_id")).alias("is_public"))


@query
def valid_year(spark, sf):
    return papers(spark, sf).select("doc_id", ids.valid_year(ids.year_of(F.col("published"))).alias("good"), ids.valid_year(F.concat(ids.year_of(F.col("published")), F.lit("\n"))).alias("with_newline"))


@query
def year_from_id(spark, sf):
    return papers(spark, sf).select("doc_id", ids.year_from_id(F.col("paper_id")).alias("year"), titles.year_from_filename(F.format_string("%07d", F.col("doc_id") * 9001 % 10000000)).alias("file_year"))


@query
def filter_author(spark, sf):
    return papers(spark, sf).filter(ids.author_in(F.col("authors"), ["Ann Author", "A. Author", "Ann B. Author"])).select("doc_id")


@query
def author_contains(spark, sf):
    return papers(spark, sf).filter(ids.author_contains(F.col("authors"), "Author-")).select("doc_id")


@query
def filter_category(spark, sf):
    return papers(spark, sf).filter(ids.category_ok(F.col("primary_category"))).select("doc_id", "primary_category")


@query
def filter_reason_counts(spark, sf):
    return ingest.filtered(papers(spark, sf), ["Ann Author"])[1]


def _stems(spark, sf):
    i = F.col("doc_id")
    stem = (
        F.when(i % 6 == 0, F.format_string("00%05d", i)).when(i % 6 == 1, F.format_string("%07d", 8700000 + i)).when(i % 6 == 2, F.concat(F.lit("BF0"), i.cast("string")))
        .when(i % 6 == 3, F.concat(F.lit("PhysRevD."), i.cast("string"))).when(i % 6 == 4, F.concat(F.lit("1-s2.0-"), F.format_string("%016d", i * 1234567), F.lit("-main"))).otherwise(F.concat(F.lit("1-s2.0-"), i.cast("string"), F.lit("-main")))
    )
    return papers(spark, sf).withColumn("stem", stem)


@query
def filename_rules(spark, sf):
    return ingest.identity_keys(_stems(spark, sf).select("stem", "text")).filter("kind <> 'title'").select("stem", "kind", "key", "canonical")


@query
def title_candidate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", titles.title_candidate(F.concat(F.lit("% head line here\n short \n"), F.col("text"))).alias("candidate"))


@query
def corpus_id(spark, sf):
    i = F.col("doc_id")
    eprint = F.when(i % 3 == 0, F.col("paper_id")).when(i % 3 == 1, F.lit(""))
    recid = F.when(i % 2 == 0, i.cast("string"))
    return papers(spark, sf).select("doc_id", ids.corpus_id(eprint, recid, F.concat(F.lit("pii:"), i.cast("string"))).alias("corpus_id"))


@query
def identify_files(spark, sf):
    files = _stems(spark, sf).select("stem", F.lit("").alias("text")).distinct()
    known = _stems(spark, sf).filter("doc_id % 6 IN (0, 2)").select(F.when(F.col("doc_id") % 6 == 0, "recid").otherwise("doi").alias("kind"), F.when(F.col("doc_id") % 6 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("10.1007/"), F.col("stem"))).alias("key"), F.col("doc_id").cast("string").alias("recid"), F.when(F.col("doc_id") % 4 == 0, F.col("paper_id")).alias("eprint"))
    return ingest.identify(files, known.filter("kind <> 'recid' OR key <> '0'")).select("stem", "paper_id", "canonical")


@query
def extract_citations(spark, sf):
    return answers(spark, sf).select("seq", F.array_sort(citations.extract_citations(F.col("answer"))).alias("cited"))


@query
def outside_marker(spark, sf):
    return answers(spark, sf).select("seq", citations.outside_marker(F.col("answer")).alias("outside"))


def _validated(spark, sf):
    return answers(spark, sf).withColumn("auto", citations.validation(F.col("answer"), F.col("retrieved"), F.col("expected")))


@query
def validate_citations(spark, sf):
    a = _validated(spark, sf)
    names = ["n_cited", "valid_citations", "invalid_citations", "n_invalid", "grounding_violation", "uncited", "marked_outside_corpus", "expected_ids", "cites_expected", "retrieval_hit"]
    return a.select("seq", *[F.col(f"auto.{n}").alias(n) for n in names], F.round("auto.expected_citation_recall", 6).alias("citation_recall"), F.round("auto.retrieval_recall", 6).alias("retrieval_recall"))


@query
def guardrail_prompt(spark, sf):
    return _validated(spark, sf).filter("auto.grounding_violation").select("seq", citations.correction(F.col("auto.invalid_citations"), F.col("retrieved")).alias("correction"))


@query
def guardrail_replay(spark, sf):
    """Recorded turns as attempts: the first grounded one ends the loop, three at most."""
    a = _validated(spark, sf).withColumn("attempt", F.floor(F.col("turn") / 2) + 1).filter("attempt <= 3")
    good = F.min(F.when(~F.col("auto.grounding_violation"), F.col("attempt")))
    return a.groupBy("conv_id").agg(good.isNotNull().alias("grounded"), F.coalesce(good, F.max("attempt")).alias("attempts"))


@query
def guardrail_loop(spark, sf):
    """Guarded generation of every conversation; a scripted generator says its recorded turns one after the other."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "answer"))
    turns = answers(spark, sf).select(F.col("conv_id").cast("string").alias("key"), place.alias("attempt"), "answer", "retrieved")
    prompts = turns.filter("attempt = 1").select("key", F.lit("script").alias("backend"), F.lit("s").alias("system"), F.lit("u").alias("user"), F.col("retrieved").alias("retrieved_ids"))
    ask = lambda due: due.select("key", "attempt").join(turns.select("key", "attempt", "answer"), ["key", "attempt"], "left").select("key", "answer", F.when(F.col("answer").isNull(), "no more turns").alias("error"))
    done = generate.grounded_answers(prompts, ask, f"{shared_dir(spark)}/groundlake/attempts-{uuid.uuid4().hex}")
    return done.select(F.col("key").cast("long").alias("conv_id"), F.md5("answer").alias("answer_md5"), "grounded", "attempts", F.col("error").isNotNull().alias("ran_out"))


@query
def anti_existing(spark, sf):
    p = papers(spark, sf).select("paper_id", "doc_id")
    return ingest.new_rows(p.unionByName(p), p.filter("doc_id % 4 <> 1")).select("paper_id")


@query
def join_missing(spark, sf):
    p = papers(spark, sf).select("paper_id", "doc_id")
    blobs = p.filter("doc_id % 3 <> 0").select(ids.safe_name(F.col("paper_id")).alias("safe"), F.lit(1).alias("blob"))
    found, missing = ingest.with_blobs(p, blobs)
    return found.select(F.lit("found").alias("reason")).unionByName(missing.select(F.lit("no_src").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query
def fallback_chain(spark, sf):
    i = F.col("doc_id")
    docs = F.when(i % 3 == 0, F.array(F.struct(F.lit("").alias("url"), F.lit("a.pdf").alias("filename"), F.lit("k").alias("key")), F.struct(F.concat(F.lit("https://x/"), i.cast("string")).alias("url"), F.lit("A.PDF").alias("filename"), F.lit("k").alias("key"))))
    url = ingest.first_url(attached=ingest.document_url(docs), by_doi=F.when(i % 2 == 0, F.concat(F.lit("d"), i.cast("string"))), located=F.when(i % 5 == 0, F.concat(F.lit("l"), i.cast("string"))))
    return table(spark, sf, "documents").withColumn("u", url).select("doc_id", "u.label", "u.url")


def _index(spark, sf):
    """Vectors with the papers that stand for their passages, one row each."""
    p = papers(spark, sf)
    n = p.count()
    return _vectors(spark, sf).withColumn("doc_id", F.col("vec_id") % n).join(p.select("doc_id", "paper_id", "title", "published"), "doc_id")


@query
def export_public(spark, sf):
    return index.public_rows(_index(spark, sf)).select("vec_id", "paper_id")


@query
def export_semi(spark, sf):
    chunks = chunk.chunk_papers(papers(spark, sf), least_words=1).select("chunk_id", "paper_id")
    return index.of_papers(chunks, index.public_rows(_index(spark, sf))).select("chunk_id")


@query
def export_manifest(spark, sf):
    return index.manifest_counts(_index(spark, sf))


@query
def delta_append(spark, sf):
    old = papers(spark, sf).filter("doc_id % 2 = 0").select("paper_id", "doc_id")
    new = papers(spark, sf).select("paper_id", "doc_id")
    once = old.unionByName(index.new_papers(new, old))
    return once.unionByName(index.new_papers(new, once))


@query
def dedup_papers(spark, sf):
    i = _index(spark, sf).select("paper_id", "title", ids.year_of(F.col("published")).alias("year"), F.col("vec_id").alias("chunk_idx"))
    return resolve.papers_of(i).select("paper_id", "year", "norm")


def _ranks(spark, sf):
    """Labels stand for papers: the expected id of a question is its own label and the next."""
    e = table(spark, sf, "embeddings")
    hits = _hits(spark, sf).join(e.select("vec_id", F.col("label").cast("string").alias("paper_id")), "vec_id")
    own = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.explode(F.array(F.col("label").cast("string"), ((F.col("label") + 1) % 10).cast("string"))).alias("expected_id"))
    return retrieve.expected_ranks(hits, own)


@query
def expected_rank(spark, sf):
    return _ranks(spark, sf).select("qid", "expected_id", "rank")


@query
def recall_preview(spark, sf):
    return evaluate.recall_total(evaluate.recall_preview(_ranks(spark, sf)))


@query
def eval_fanout(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    names = spark.createDataFrame([("alpha",), ("beta",)], "backend string")
    conditions = spark.createDataFrame([("rag", 8), ("closed_book", 0)], "condition string, k int")
    return evaluate.fan_out(q, names, conditions)


def _run(spark, sf):
    a = _validated(spark, sf)
    human = F.struct("correctness", "faithfulness", F.when(F.col("type") == "out_of_corpus", F.col("faithfulness")).alias("refusal_ok"), F.when(F.col("conv_id") % 10 == 0, "see text").alias("notes"))
    auto = F.when(F.col("error").isNull(), F.col("auto"))
    return a.select("seq", F.col("conv_id").cast("string").alias("qid"), "backend", "condition", "type", "error", F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"), auto.alias("auto"), human.alias("human"))


@query
def eval_summary(spark, sf):
    return evaluate.summary(_run(spark, sf))


@query
def eval_markdown(spark, sf):
    return evaluate.markdown_rows(evaluate.summary(_run(spark, sf)))


@query
def rag_vs_closed(spark, sf):
    return evaluate.rag_vs_closed(evaluate.summary(_run(spark, sf)), "n_scored")


@query
def failure_lines(spark, sf):
    return evaluate.failures(_run(spark, sf)).select("seq", "line", "violation", "correctness", "n_invalid")


@query
def format_passages(spark, sf):
    p = _passages(spark, sf).withColumn("p", prompts.passage(F.col("rank"), F.col("score"), F.col("source"), F.col("paper_id"), F.col("year"), text.snippet(F.col("text"))))
    return p.groupBy("qid").agg(prompts.joined_passages(F.col("rank"), F.col("p")).alias("passages"))


@query
def prompt_rag(spark, sf):
    return format_passages(spark, sf).select("qid", prompts.rag_prompt(F.concat(F.lit("Q"), F.col("qid").cast("string")), F.col("passages")).alias("prompt"))


@query
def prompt_closed(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", prompts.closed_prompt(F.col("text")).alias("prompt"))


@query
def title_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", titles.normalize_title(F.concat(F.lit("\\alpha{X}-"), F.col("text"))).alias("norm"))


@query
def split_year(spark, sf):
    q = F.concat(F.col("source"), F.lit(" (verify) in 1985, again ("), (1950 + F.col("doc_id") % 200).cast("string"), F.lit(") end"))
    return table(spark, sf, "documents").withColumn("s", titles.split_year(q)).select("doc_id", "s.title", "s.year")


@query
def resolve_titles(spark, sf):
    known = resolve.papers_of(_index(spark, sf).select("paper_id", "title", ids.year_of(F.col("published")).alias("year"), F.col("vec_id").alias("chunk_idx")))
    asked = papers(spark, sf).filter("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("qid"), F.concat("title", F.lit(" ("), ids.year_of(F.col("published")), F.lit(")")).alias("query"))
    return resolve.resolve(asked, known)


@query
def health_counts(spark, sf):
    return health.counts(_vectors(spark, sf), table(spark, sf, "documents"))


@query
def health_report(spark, sf):
    """Constraints of the papers and of a version of them that has each twice, a pass each."""
    p = papers(spark, sf).select("paper_id", "title", "published")
    one = checks.checked(p, checks.paper_constraints(), (checks.unique("paper_id"),))
    two = checks.checked(p.unionByName(p).withColumn("paper_id", F.when(F.col("paper_id").startswith("inspire"), "").otherwise(F.col("paper_id"))), checks.paper_constraints(), (checks.unique("paper_id", fatal=False),))
    return one.withColumn("seen", F.lit("once")).unionByName(two.withColumn("seen", F.lit("twice")))


@query
def health_unique(spark, sf):
    p = papers(spark, sf)
    return health.uniqueness(p.unionByName(p.filter("doc_id % 10 = 0")))


@query
def health_years(spark, sf):
    return health.bad_years(papers(spark, sf).withColumn("title", F.col("source")))


@query
def pdf_method(spark, sf):
    words = F.size(text.tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", archive.pdf_choice([("text", words - 60, 150), ("ocr", words, 50)]).alias("method"))


def _rejects(spark, sf):
    return papers(spark, sf).select("paper_id", F.when(F.col("doc_id") % 2 == 0, ids.year_of(F.col("published"))).alias("year"))


@query
def rejects_shown(spark, sf):
    return delta.shown_rejects(_rejects(spark, sf))


@query
def join_metadata(spark, sf):
    p = papers(spark, sf)
    got = p.filter("doc_id % 3 = 0").select(ids.safe_name(F.col("paper_id")).alias("safe"), F.col("n_chars").alias("length"))
    return delta.with_metadata(got, p.withColumn("paper_id", F.concat("paper_id", F.lit("v2")))).select("safe", "length", "paper_id", "published")


@query
def api_rows(spark, sf):
    none = F.lit(None).cast("string")
    p = papers(spark, sf)
    raw = p.select(F.concat(F.lit("http://host/abs/"), "paper_id").alias("entry_id"), F.concat(F.lit(" \n"), "source", F.lit("\t")).alias("title"), "authors", F.concat(F.lit("  a "), "source", F.lit("\n")).alias("summary"), "published", F.col("published").alias("updated"), "primary_category", F.array("primary_category").alias("categories"), none.alias("pdf_url"), none.alias("comment"), none.alias("journal_ref"), none.alias("doi"))
    return ingest.paper_rows(raw).select("paper_id", "title", "abstract", "published", "primary_category")


def _catalogue(spark, sf):
    i = F.col("doc_id")
    p = papers(spark, sf)
    eprint = F.struct(F.col("paper_id").alias("value"), F.when(i % 4 == 0, F.array("primary_category")).otherwise(F.array().cast("array<string>")).alias("categories"))
    has = (i % 2 == 0) & ids.is_public(F.col("paper_id"))
    return p.select(
        "doc_id", i.cast("string").alias("recid"), F.when(has, F.array(eprint)).alias("arxiv_eprints"), F.when(i % 3 > 0, F.array(F.struct(F.concat(F.lit(" "), "source", F.lit(" ")).alias("title")))).alias("titles"),
        F.when(i % 5 > 0, F.array(F.struct(F.lit("A").alias("full_name")), F.struct(F.lit(None).cast("string").alias("full_name")))).alias("authors"),
        F.when(i % 7 == 0, F.array(F.struct(F.lit("1984").alias("year"), F.lit("J").alias("journal_title")))).alias("publication_info"), F.array().cast("array<struct<value:string>>").alias("dois"),
    )


@query
def catalogue_papers(spark, sf):
    return ingest.catalogue_rows(_catalogue(spark, sf)).select("paper_id", "title", "authors", "published", "primary_category", "pdf_url", "journal_ref")


@query
def without_eprint(spark, sf):
    return ingest.without_eprint(_catalogue(spark, sf)).select("doc_id")


@query
def main_tex(spark, sf):
    one = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("content"))
    body = F.col("source")
    classed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\documentclass{a}"), body)).otherwise(body)
    files = F.array(one("longer.tex", F.concat(classed, F.lit("1"))), one("a.tex", F.concat(body, F.lit("2"))), one("other.tex", F.concat(classed, F.lit("3"))))
    return table(spark, sf, "documents").select("doc_id", archive.main_file(files).alias("main"))


@query
def query_prefix(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", vectors.prefixed(F.col("text")).alias("question"))


@query
def year_adjust(spark, sf):
    ratio = (F.col("doc_id") % 101) / F.lit(100.0)
    wanted = F.when(F.col("doc_id") % 3 > 0, (1976 + F.col("doc_id") % 25).cast("string"))
    year = F.when(F.col("doc_id") % 11 > 0, (1976 + F.col("doc_id") % 50).cast("string")).otherwise("")
    s = F.round(titles.adjusted(ratio, wanted, year), 3)
    return table(spark, sf, "documents").select("doc_id", s.alias("score"), titles.band(s).alias("band"))


@query
def open_access(spark, sf):
    url = F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))
    pdf = F.struct(F.struct(url.alias("url")).alias("openAccessPdf"))
    none = F.struct(F.lit(None).cast("struct<url:string>").alias("openAccessPdf"))
    response = F.when(F.col("doc_id") % 3 == 0, F.to_json(pdf)).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.array(none, pdf).alias("data")))).otherwise("{}")
    best = F.to_json(F.struct(F.struct(url.alias("url_for_pdf")).alias("best_oa_location")))
    return table(spark, sf, "documents").select("doc_id", catalogue.open_access_url(response).alias("listed"), catalogue.best_location_url(best).alias("best"))


@query
def title_similarity(spark, sf):
    """Each document's title against that of the next document."""
    p = papers(spark, sf).select("doc_id", titles.normalize_title(F.coalesce("title", F.lit(""))).alias("a"))
    pairs = p.join(p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return resolve.title_pairs(pairs).select("doc_id", F.round("similarity", 6).alias("similarity"))
