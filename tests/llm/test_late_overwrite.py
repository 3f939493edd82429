"""Late arrivals that overwrite day partitions, against plain Python and on disk."""

from __future__ import annotations

import glob
import hashlib
import random
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from groundlake.llm import late_overwrite
from groundlake.llm.common import shared_dir
from groundlake.llm.late_overwrite import Layout, late_sales

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
NAMES = [c.split()[0] for c in SALES.split(", ")]
CUT, EPOCH = datetime(2024, 4, 10), datetime(1970, 1, 1)


def sales(n=400, hot=0):
    """Sales with repeated and null ids, nulls in every column, rows that move to another day, a hot day."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        sold = datetime(2024, 3, 25) + timedelta(seconds=rng.randrange(20 * 86400)) if i >= hot else datetime(2024, 4, 4, 1)
        came = sold + timedelta(hours=rng.choice([0, 1, 30, 200]))
        rows.append((i if rng.random() < 0.9 else rng.randrange(n), rng.choice([1, 7, None]), rng.choice(["open", "done", None]), rng.choice([None, round(rng.random() * 100, 2)]), rng.choice([None] + [sold] * 20), rng.choice([None] + [came] * 30), rng.choice([None, 1])))
    return [*rows, rows[5], rows[5], (None, 1, "x", 1.0, datetime(2024, 4, 2), datetime(2024, 4, 2), 1), (None, 2, "y", 2.0, datetime(2024, 4, 3), datetime(2024, 4, 20), 1), (-3, 1, "before", 1.005, datetime(1969, 12, 31, 23), datetime(2024, 4, 1), 1)]


def day(r):
    return -1 if r[4] is None else (r[4] - EPOCH).days


def stands(rows):
    low = lambda v: (v is not None, v)
    best = {}
    for r in rows:
        k = tuple(low(v) for v in (r[5], r[1], r[2], r[3], r[4], r[6]))
        if r[0] not in best or k > best[r[0]][0]:
            best[r[0]] = (k, r)
    return {i: r for i, (_, r) in best.items()}


def cut(kept, size):
    by = {}
    for r in kept.values():
        by.setdefault(day(r), []).append(r)
    low = lambda v: (v is not None, v)
    return {d: [x[i : i + size] for i in range(0, len(x), size)] for d, x in ((d, sorted(x, key=lambda r: (low(r[4]), low(r[0])))) for d, x in by.items())}


def brute(rows, size):
    every = []
    for r in rows:
        every.append(r)
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 3 == 0 and day(r) % 7 == 0:
            later = lambda t, n: t and t + timedelta(days=n)
            every.append((r[0], r[1], r[2], None if r[3] is None else r[3] + 1, later(r[4], h % 2), later(r[5], 1 + h % 97), r[6]))
    early = [r for r in every if r[5] is not None and r[5] < CUT]
    late = [r for r in every if r[5] is None or r[5] >= CUT]
    start, end = stands(early), stands(every)
    news = [(i, r) for i, r in end.items() if r in late and r not in early]
    touched = {day(r) for _, r in news} | {day(start[i]) for i, _ in news if i in start}
    micro = lambda t: "" if t is None else str((t - EPOCH) // timedelta(microseconds=1))
    text = lambda v: "" if v is None else str(v)
    out = []
    for d, files in cut(end, size).items():
        for no, f in enumerate(files):
            cents = sum(0 if r[3] is None else int((100 * r[3] + 0.5) // 1) for r in f)
            crc = sum(zlib.crc32(f"{text(r[0])}:{micro(r[4])}:{micro(r[5])}".encode()) for r in f)
            out.append((d, no, len(f), cents, crc, ",".join(NAMES), hashlib.sha256(",".join(text(r[0]) for r in f).encode()).hexdigest(), d in touched))
    return sorted(out)


def report(df):
    return sorted((r.day, r.file_no, r.n_rows, r.cents, r.rows_crc, r.columns, r.ids_sha256, r.rewritten) for r in df.collect())


@pytest.mark.parametrize(("n", "hot", "size"), [(300, 0, 6), (500, 250, 25)])
def test_report_equals_brute_force(spark, n, hot, size):
    rows = sales(n, hot)
    assert report(late_sales(spark.createDataFrame(rows, SALES).repartition(5), file_rows=size)) == brute(rows, size)


def test_file_size_follows_the_rows(spark):
    rows = sales(500)
    assert report(late_sales(spark.createDataFrame(rows, SALES), share=30)) == brute(rows, 1 + len(rows) // 30)


def layout(spark, name, like, size=25):
    return Layout(spark, f"{shared_dir(spark)}/{name}", like, key="sale_id", sold="sold_at", arrived="arrived_at", file_rows=size)


def on_disk(at):
    top = at.root.removeprefix("file://")
    return {p.removeprefix(top): open(p, "rb").read() for p in glob.glob(f"{top}/**/*.parquet", recursive=True)}


def split(spark):
    df = spark.createDataFrame(sales(), SALES)
    early = "coalesce(arrived_at < timestamp_ntz'2024-04-10', false)"
    return df.filter(early), df.filter(f"NOT {early}")


def test_untouched_files_stay_and_no_others_remain(spark):
    early, late = split(spark)
    at = layout(spark, "lo-bytes", early.schema)
    at.start(early)
    before = on_disk(at)
    days = at.overwrite(late)
    after = on_disk(at)
    kept = {p: b for p, b in before.items() if int(p.split("day=")[1].split("/")[0]) not in days}
    assert kept and days and {p: b for p, b in after.items() if p in before} == kept
    assert not any("_staged" in p or "_aside" in p for p in after)
    assert all(pq.ParquetFile(at.root.removeprefix("file://") + p).schema_arrow.names == NAMES for p in after)
    assert at.overwrite(late) == [] and on_disk(at) == after


@pytest.mark.parametrize("fails_at", [1, 4])
def test_a_broken_publication_is_finished(spark, fails_at, monkeypatch):
    early, late = split(spark)
    whole = layout(spark, f"lo-whole-{fails_at}", early.schema)
    whole.start(early)
    whole.overwrite(late)
    at = layout(spark, f"lo-broken-{fails_at}", early.schema)
    at.start(early)
    moves, real = [], late_overwrite._must

    def must(done, what):
        moves.append(what)
        if len(moves) == fails_at:
            raise RuntimeError("lost the driver")
        real(done, what)

    monkeypatch.setattr(late_overwrite, "_must", must)
    with pytest.raises(RuntimeError):
        at.overwrite(late)
    monkeypatch.undo()
    assert at.overwrite(late) == []
    rows = lambda x: sorted(map(str, x.rows().collect()))
    assert rows(at) == rows(whole)
    assert [p.split("/")[1] for p in sorted(on_disk(at))] == [p.split("/")[1] for p in sorted(on_disk(whole))]


def test_a_stage_that_is_not_whole_is_dropped(spark, monkeypatch):
    early, late = split(spark)
    at = layout(spark, "lo-half", early.schema)
    at.start(early)
    before = on_disk(at)
    monkeypatch.setattr(Layout, "_mark", lambda self, days: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        at.overwrite(late)
    monkeypatch.undo()
    at.recover()
    assert on_disk(at) == before


def test_a_day_that_empties_goes(spark):
    row = lambda day, came: (1, 1, "x", 1.0, datetime(2024, 4, day), datetime(2024, 4, came), 1)
    at = layout(spark, "lo-gone", spark.createDataFrame([], SALES).schema)
    at.start(spark.createDataFrame([row(1, 1)], SALES))
    assert at.overwrite(spark.createDataFrame([row(2, 12)], SALES)) == [19814, 19815]
    assert at.days() == ["day=19815"]


def test_empty_and_clashing(spark):
    assert late_sales(spark.createDataFrame([], SALES)).collect() == []
    rows = sales(60)
    extra = spark.createDataFrame(rows, SALES).selectExpr("*", "'mine' AS day", "1 AS _day", "2 AS _file", "'x' AS _metadata", "3 AS c0")
    got = late_sales(extra, file_rows=9).collect()
    want = brute(rows, 9)
    assert sorted((r.day, r.file_no, r.n_rows, r.cents, r.rows_crc) for r in got) == [w[:5] for w in want]
    assert {r.columns for r in got} == {",".join([*NAMES, "day", "_day", "_file", "_metadata", "c0"])}


def test_times_with_a_zone(spark):
    rows = sales(80)
    df = spark.createDataFrame(rows, SALES).selectExpr(*[f"CAST({c} AS timestamp) AS {c}" if c.endswith("_at") else c for c in NAMES])
    assert report(late_sales(df, file_rows=9)) == brute(rows, 9)
