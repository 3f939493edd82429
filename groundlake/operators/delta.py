"""New papers from their ids to the index in one call, and what was turned down (OPS-3, JN-2, SNK-5, SRT-5, SRT-7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import safe_name, strip_version
from .archive import extract, latex_to_text, main_file
from .chunk import chunk_papers
from .counters import counted
from .index import new_papers
from .versions import Versions


def with_metadata(downloads: DataFrame, papers: DataFrame) -> DataFrame:
    """Downloads joined to the paper rows of their bare ids; downloads without one are left out."""
    keyed = papers.withColumn("safe", safe_name(strip_version(F.col("paper_id"))))
    return downloads.join(keyed, "safe")


def parsed(papers: DataFrame, blobs: DataFrame) -> DataFrame:
    """Papers that have a source, with its text; an archive without text gives a null or empty one."""
    found = with_metadata(blobs.filter("content IS NOT NULL").select("safe", "content"), papers)
    return found.withColumn("text", latex_to_text(main_file(extract("content")))).drop("content", "safe")


def rejects_of(papers: DataFrame, blobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A reject for every paper that gave no chunk, with its reason."""
    bare = strip_version(F.col("paper_id"))
    lost = papers.withColumn("bare", bare).join(chunks.select(F.col("paper_id").alias("bare")).distinct(), "bare", "left_anti")
    had = with_metadata(blobs.filter("content IS NOT NULL").select("safe"), papers).select(bare.alias("bare"), F.lit("not parsed").alias("reason")).distinct()
    none = F.lit(None).cast("string")
    return lost.join(had, "bare", "left").select("paper_id", "title", F.substring("published", 1, 4).alias("year"), "doi", none.alias("tried_url"), none.alias("file"), F.coalesce("reason", F.lit("no source")).alias("reason"))


def prepared(papers: DataFrame, blobs: DataFrame, encode: Callable[[DataFrame], DataFrame], *, least_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """Index rows of papers with their sources, and a reject for every paper that gives none.

    ``blobs`` has ``safe, content`` (null where a download failed); ``encode`` adds the
    vectors to chunk rows.
    """
    chunks = chunk_papers(parsed(papers, blobs), least_words=least_words)
    return encode(chunks), rejects_of(papers, blobs, chunks)


def add_papers(papers: DataFrame, download: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame], index_path: str, *, rejects_path: str | None = None, least_words: int = 50) -> dict[str, int]:
    """Downloads, parses, cuts, encodes and adds the papers that the index lacks; the counts of each stage.

    ``download`` takes ``safe, url`` and returns ``safe, content``; it and the parser run
    once, and what they gave is written as batches that no version has yet. One commit
    then adds the chunks to ``index``, the papers that gave some to ``papers`` and the
    others to ``rejects``: after a crash at any point a second call finds all three as they
    were or as they should be. ``rejects_path`` gets this call's rejects as JSON besides.

    Counts: ``asked, failed`` (downloads), ``parsed, empty`` (texts), ``chunks``, ``rejects``,
    ``index, papers`` (rows added). They are taken while the rows are written.
    """
    spark = papers.sparkSession
    at = Versions(spark, index_path)
    bare = papers.withColumn("paper_id", strip_version(F.col("paper_id"))).dropDuplicates(["paper_id"])
    todo = new_papers(bare, at.read("index"))
    wanted = todo.select(safe_name(F.col("paper_id")).alias("safe"), F.col("pdf_url").alias("url"))
    got, fetched = counted(download(wanted).select("safe", "content"), asked=F.lit(True), failed=F.col("content").isNull())
    _, blobs = at.write("blobs", got)
    texts, read = counted(parsed(todo, blobs), parsed=F.lit(True), empty=F.coalesce(F.trim("text"), F.lit("")) == "")
    rows, cut = counted(encode(chunk_papers(texts, least_words=least_words)), chunks=F.lit(True))
    _, fresh_rows = at.write("index", rows.select(*at.read("index").columns))
    lost, turned_down = counted(rejects_of(todo, blobs, fresh_rows), rejects=F.lit(True))
    _, rejects = at.write("rejects", lost)
    counts = fetched.get | read.get | cut.get | turned_down.get | {"index": 0, "papers": 0}
    if rejects_path:
        write_rejects(rejects, rejects_path)
    added: list = []

    def change(base: int) -> dict[str, DataFrame]:
        fresh = new_papers(fresh_rows, at.read("index", base))
        index, n_index = counted(fresh, index=F.lit(True))
        kept, n_papers = counted(bare.join(fresh.select("paper_id").distinct(), "paper_id", "left_semi"), papers=F.lit(True))
        added[:] = [n_index, n_papers]
        return {"index": index, "papers": kept, "rejects": rejects}

    if counts["chunks"] or counts["rejects"]:
        at.commit(change)
        for seen in added:
            counts |= seen.get
    return counts


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Rejects by year, those without one first, in place of earlier ones."""
    rejects.orderBy(F.coalesce("year", F.lit("")), "paper_id").write.mode("overwrite").json(path)


def shown_rejects(rejects: DataFrame, show: int = 15) -> DataFrame:
    """The earliest rejects, those without a year last."""
    return rejects.orderBy(F.coalesce("year", F.lit("9999")), "paper_id").limit(show)
