"""Small documents with every awkward case, and plain-Python versions of the contracts."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages, nulls, odd spaces, one long text."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (40, 60, 120, 300, 80, 55)]
    passage = words(rng, 60)
    near = base[3].split(" ")
    near[150] = "changed"
    texts = [
        *base,
        base[0],
        base[3].upper(),
        " ".join(near),
        passage,
        base[1] + "\n" + passage + "\nshort\nshort",
        "intro line of some length\n" + passage + "\n" + base[4],
        "  Intro LINE of some length\t\nshort\nintro line of some length",
        None,
        "",
        "   \t\n ",
        "one two",
        "one  two",
        "one two three four",
        "a" * 500,
        "a" * 350,
        "12345 !!! 678",
        "nul\x00byte \x1c sep\x85 x",
        "Ünïcode ΑΣ İx <|endoftext|> it's we'll 12 😀",
        words(rng, 9000),
        words(rng, 100) + " " + base[2] + " " + words(rng, 90),
    ]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "srcÄ", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (3, "same id, other text\n" + passage, "en", "src1", 1), (None, base[5], None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)


def clash(df, *names):
    """Adds columns whose names an operator uses itself."""
    for n in names:
        df = df.selectExpr("*", f"'mine' AS `{n}`")
    return df


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text, n=5):
    w = tokens(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])
