"""Source archives and PDFs to text (BIN-1 to BIN-3, SRT-3, TXT-6)."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LATEX_MARKS, latex_strip, text_cleanup


def tar_members(blob: bytes) -> list[tuple[str, str]]:
    """Name and text of the LaTeX members of an archive, whatever its compression."""
    try:
        with tarfile.open(fileobj=io.BytesIO(blob), mode="r:*") as tar:
            files = [m for m in tar if m.isfile() and m.name.lower().endswith(".tex")]
            return [(m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in files]
    except (tarfile.TarError, EOFError, OSError, ValueError):
        return []


def latex_files(blob: bytes | None) -> list[tuple[str, str]]:
    """LaTeX files of a blob: an archive, a zipped archive or file, or plain text; else none."""
    if not blob:
        return []
    if found := tar_members(blob):
        return found
    raw = blob
    try:
        raw = gzip.decompress(blob)
        if found := tar_members(raw):
            return found
    except (OSError, EOFError):
        pass
    for data in dict.fromkeys((raw, blob)):
        text = data.decode("utf-8", "replace")
        if any(m in text for m in LATEX_MARKS):
            return [("main.tex", text)]
    return []


def extract(blobs: Column | str) -> Column:
    """Arrow stage: the LaTeX files of each blob."""

    @F.pandas_udf("array<struct<name: string, content: string>>")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: [{"name": n, "content": c} for n, c in latex_files(b)])

    return run(blobs)


def main_file(files: Column) -> Column:
    """Content of the file with the shortest name, of those with a document class if any; first of equals."""
    classed = F.filter(files, lambda f: f["content"].contains("\\documentclass"))
    pool = F.when(F.size(classed) > 0, classed).otherwise(files)
    return F.array_min(F.transform(pool, lambda f, i: F.struct(F.length(f["name"]).alias("n"), i.alias("i"), f["content"].alias("content"))))["content"]


def latex_to_text(latex: Column, convert: Callable[[Column], Column] | None = None) -> Column:
    """Clean text of a LaTeX source.

    ``convert`` stands for a full converter; the default drops commands and keeps their
    arguments and all mathematics, which approximates one.
    """
    body = latex_strip(latex)
    if convert is None:
        for pattern, by in [(r"\\(cite|ref|eqref|label)\w*(\[[^\]]*\])*\{[^}]*\}", "<cit.>"), (r"\\(begin|end)\{[^}]*\}", ""), (r"\\[a-zA-Z]+\*?(\[[^\]]*\])?\{([^{}]*)\}", "$2")]:
            body = F.regexp_replace(body, pattern, by)
    else:
        body = convert(body)
    return text_cleanup(F.coalesce(body, F.lit("")))


def pdf_choice(words: list[tuple[str, Column, int]]) -> Column:
    """Label of the first method with enough words: ``(label, word count, least)`` in order; else ``failed``."""
    out = None
    for label, count, least in words:
        out = F.when(count >= least, label) if out is None else out.when(count >= least, label)
    return out.otherwise("failed")


def pdf_text(blobs: DataFrame, extractors: list[tuple[str, Callable[[bytes], str], int]], content_col: str = "content") -> DataFrame:
    """``blobs`` with ``text, method``: the first extractor that gives enough words.

    Extractors (label, function, least words) are injected; a failing one is passed over.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema) + ", text string, method string"

    def one(blob):
        for label, fn, least in extractors:
            try:
                text = fn(bytes(blob))
            except Exception:  # noqa: BLE001 - the next method may still work
                continue
            if len(re.split(r"\s+", text.strip())) >= least:
                return text, label
        return "", "failed"

    def run(frames):
        for frame in frames:
            got = [one(b) for b in frame[content_col]]
            yield frame.assign(text=[g[0] for g in got], method=[g[1] for g in got])

    return blobs.mapInPandas(run, schema)


def is_pdf(content: Column, least: int = 2000) -> Column:
    """Whether a download is a PDF: long enough, its mark among the first 20 bytes."""
    return (F.length(content) > least) & (F.instr(F.decode(F.substring(content, 1, 20), "ISO-8859-1"), "%PDF") > 0)
