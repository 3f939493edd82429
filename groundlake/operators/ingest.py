"""Bibliographic ingest (FLT-1 to FLT-5, FLT-15, PRJ-1/2, JN-1/6/12/13, AGG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ids import author_in, category_ok, corpus_id, dated, strip, strip_version, year_from_id
from ..functions.titles import padded_recid, pii, pii_dois, publisher_doi, report_number, title_candidate
from .counters import counted


def paper_rows(records: DataFrame) -> DataFrame:
    """Paper rows of bibliographic API records; the id is what follows ``/abs/``."""
    return records.select(
        F.element_at(F.split("entry_id", "/abs/"), -1).alias("paper_id"), strip(F.col("title")).alias("title"), "authors", strip(F.col("summary")).alias("abstract"), "published", "updated", "primary_category", "categories", "pdf_url", "comment", "journal_ref", "doi"
    )


def filter_reason(authors: Column, category: Column, names: list[str]) -> Column:
    """Why a record goes, authors tested before categories; ``kept`` if it stays."""
    return F.when(~author_in(authors, names), "skipped_author").when(~category_ok(category), "skipped_category").otherwise("kept")


def filtered(papers: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Papers that stay and the number of records by reason."""
    marked = papers.withColumn("reason", filter_reason(F.col("authors"), F.col("primary_category"), names))
    return marked.filter("reason = 'kept'").drop("reason"), marked.groupBy("reason").agg(F.count("*").alias("n"))


def filtered_counting(papers: DataFrame, names: list[str]) -> tuple[DataFrame, Observation]:
    """Papers that stay; the numbers of ``kept, skipped_author, skipped_category`` come with the action that takes them."""
    marked, seen = counted(papers.withColumn("_reason", filter_reason(F.col("authors"), F.col("primary_category"), names)), **{r: F.col("_reason") == r for r in ("kept", "skipped_author", "skipped_category")})
    return marked.filter("_reason = 'kept'").drop("_reason"), seen


def new_rows(rows: DataFrame, existing: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows whose key is new, once each."""
    return rows.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def catalogue_rows(records: DataFrame, default_category: str = "hep-th") -> DataFrame:
    """Paper rows of catalogue records; what is missing gets the defaults."""
    eprint = F.get("arxiv_eprints", F.lit(0))
    year = F.get("publication_info", F.lit(0))["year"]
    bare = eprint["value"]
    known = F.coalesce(F.nullif(year, F.lit("")), year_from_id(bare), F.lit("????"))
    category = F.coalesce(F.get(eprint["categories"], F.lit(0)), F.lit(default_category))
    return records.select(
        corpus_id(bare, F.col("recid"), F.lit(None).cast("string")).alias("paper_id"),
        F.coalesce(strip(F.get("titles", F.lit(0))["title"]), F.lit("")).alias("title"),
        F.transform(F.coalesce("authors", F.array()), lambda a: F.coalesce(a["full_name"], F.lit(""))).alias("authors"),
        F.lit("").alias("abstract"),
        dated(known).alias("published"),
        dated(known).alias("updated"),
        category.alias("primary_category"),
        F.array(category).alias("categories"),
        F.when(bare.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), bare)).alias("pdf_url"),
        F.lit(None).cast("string").alias("comment"),
        F.get("publication_info", F.lit(0))["journal_title"].alias("journal_ref"),
        F.get("dois", F.lit(0))["value"].alias("doi"),
    )


def without_eprint(records: DataFrame) -> DataFrame:
    return records.filter(F.coalesce(F.size("arxiv_eprints"), F.lit(0)) == 0)


def document_url(documents: Column) -> Column:
    """URL of the first attached document that is a PDF by address, file name or key."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    is_pdf = lambda d: (F.coalesce(d["url"], F.lit("")) != "") & (
        low(d["url"]).endswith(".pdf") | low(d["filename"]).endswith(".pdf") | low(d["key"]).contains("pdf") | d["url"].contains("inspirehep.net/files")
    )
    return F.get(F.filter(documents, is_pdf), F.lit(0))["url"]


def first_url(**sources: Column) -> Column:
    """``struct(label, url)`` of the first source, in the order given, that has one."""
    label = None
    for name, url in sources.items():
        label = F.when(url.isNotNull(), name) if label is None else label.when(url.isNotNull(), name)
    return F.struct(label.alias("label"), F.coalesce(*sources.values()).alias("url"))


def with_blobs(papers: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers joined to their blobs by safe name, and the papers that have none."""
    key = F.translate(strip_version(F.col("paper_id")), "/:", "__").alias("safe")
    keyed = papers.select("*", key)
    return keyed.join(blobs, "safe"), keyed.join(blobs.select("safe"), "safe", "left_anti")


def identity_keys(files: DataFrame) -> DataFrame:
    """Candidate keys of PDF files (``stem, text``) in the order in which they are tried.

    One row per candidate: ``stem, priority, kind, key, canonical``.
    """
    item = pii(F.col("stem"))
    one = lambda kind, key, canonical: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key"), canonical.alias("canonical")))
    recid, report, doi, title = padded_recid(F.col("stem")), report_number(F.col("stem")), publisher_doi(F.col("stem")), title_candidate(F.col("text"))
    named = F.array(one("recid", recid, F.concat(F.lit("inspire:"), recid)), one("report", report, F.lit(None).cast("string")), one("doi", doi, doi))
    items = F.transform(F.when(item.isNotNull(), pii_dois(item)).otherwise(F.array().cast("array<string>")), lambda d: F.struct(F.lit("doi").alias("kind"), d.alias("key"), F.concat(F.lit("pii:"), item).alias("canonical")))
    titled = F.array(one("title", title, F.concat(F.lit("title:"), F.substring(title, 1, 40))))
    every = F.filter(F.concat(named, items, titled), lambda s: s.isNotNull())
    return files.select("stem", F.posexplode(every).alias("priority", "c")).select("stem", "priority", "c.*")


def identify(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First candidate of each file that the catalogue (``kind, key, recid, eprint``) knows.

    ``stem, paper_id, canonical``; files without a match have none of these.
    """
    known = identity_keys(files).join(catalogue, ["kind", "key"])
    best = known.groupBy("stem").agg(F.min_by(F.struct("eprint", "recid", "canonical"), "priority").alias("b"))
    canonical = F.coalesce("b.canonical", F.concat(F.lit("inspire:"), F.col("b.recid")))
    found = best.select("stem", corpus_id(F.col("b.eprint"), F.col("b.recid"), canonical).alias("paper_id"), canonical.alias("canonical"))
    return files.select("stem").join(found, "stem", "left")
