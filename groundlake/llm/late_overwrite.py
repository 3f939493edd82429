"""Late arrivals overwrite whole day partitions of a Parquet layout.

A layout holds the latest-arrived row of every key, in one directory a day, each day
sorted and cut into files of a fixed number of rows. Rows are sorted globally once; a
running number (position in the partition plus the rows of the partitions before it) less
the number at which a day begins says which file a row belongs to. The file's number is
the id of the partition that the row is sent to, so that each task writes one file. When
late rows come, the days they touch are written aside and their directories are renamed
into place; nothing else is opened for writing.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import emit_rows, shared_dir, unused, written

#: Microseconds of a day.
DAY = 86_400_000_000

#: Folders beside the days; readers skip names that begin with an underscore.
STAGED, ASIDE = "_staged", "_aside"


def micros(df: DataFrame, name: str) -> F.Column:
    """Microseconds since 1970 of a time in UTC; a time without a zone is read as UTC."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        clock = F.hour(c) * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * DAY + clock.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c)


def day_of(df: DataFrame, name: str) -> F.Column:
    """Whole days since 1970, -1 for a null."""
    at = micros(df, name)
    return F.coalesce(((at - F.pmod(at, F.lit(DAY))) / F.lit(DAY)).cast("long"), F.lit(-1).cast("long"))


def latest(rows: DataFrame, key: str, arrived: str) -> DataFrame:
    """The latest-arrived row of each key; a null key is one key, a null time the earliest.

    Equal times are settled by the other columns in order, larger ones first, so that the
    choice never depends on where rows lie. One aggregate with partial maxima: copies of a
    hot key are reduced before the shuffle.
    """
    others = [c for c in rows.columns if c not in (key, arrived)]
    best = rows.groupBy(key).agg(F.max(F.struct(arrived, *others)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col("_best")[c].alias(c) for c in rows.columns])


def numbered(rows: DataFrame, order: list[str], file_rows: int, label: str) -> tuple[DataFrame, int]:
    """``rows`` (with ``_day``) and ``_file``, a running number of files over all days; how many files there are.

    The sorted rows are written with the partition that held them and their place in it;
    one row per partition and day is enough to say where each of them begins.
    """
    ordered = rows.orderBy("_day", *order)
    placed = written(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    pieces = placed.groupBy("_part", "_day").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row per partition and day meets in one task here, never rows
    piece = Window.orderBy("_day", "_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(piece), F.lit(0)))
    days = pieces.groupBy("_day").agg(F.min("_before").alias("_base"), F.sum("_n").alias("_rows"))
    files = F.ceil(F.col("_rows") / F.lit(file_rows)).cast("long")
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_files", files).withColumn("_file_base", F.coalesce(F.sum("_files").over(earlier), F.lit(0)))
    starts = written(pieces.join(days, "_day").select("_part", "_day", (F.col("_before") - F.col("_first") - F.col("_base")).alias("_shift"), "_file_base", "_files"), f"{label}-starts")
    total = starts.agg(F.max(F.col("_file_base") + F.col("_files"))).first()[0] or 0
    # as many rows as partitions and days: what a running number over partitions needs anyway
    done = placed.join(F.broadcast(starts.drop("_files")), ["_part", "_day"])
    return done.withColumn("_file", F.col("_file_base") + F.floor((F.col("_at") + F.col("_shift")) / F.lit(file_rows)).cast("long")).drop("_part", "_at", "_shift", "_file_base"), int(total)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its class."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _must(done: bool, what: str) -> None:
    if not done:
        raise OSError(f"the file system refused to move {what}")


class Layout:
    """A layout at ``root`` of rows ``like``: one row a key, one directory a day, files of ``file_rows`` rows."""

    def __init__(self, spark: SparkSession, root: str, like: T.StructType, *, key: str, sold: str, arrived: str, file_rows: int):
        self.spark, self.root, self.like, self.file_rows = spark, root, like, file_rows
        #: The partition column; rows may have a column ``day`` of their own.
        self.day = unused(spark.createDataFrame([], like), "day")[0]
        names = [f"c{i}" for i in range(len(like))]
        self.key, self.sold, self.arrived = (names[like.names.index(x)] for x in (key, sold, arrived))
        self.names = names

    def plain(self, rows: DataFrame) -> DataFrame:
        """``rows`` under names that clash with nothing."""
        return rows.toDF(*self.names)

    def days(self, below: str = "") -> list[str]:
        """Names of the day directories; they grow with time, not with rows."""
        fs, p = _files(self.spark, self.root + below)
        return [n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(f"{self.day}=")] if fs.exists(p) else []

    def files(self) -> DataFrame | None:
        """The rows as they lie, with the partition column; ``None`` if there is no file."""
        if not self.days():
            return None
        return self.spark.read.schema(T.StructType([*self.like.fields, T.StructField(self.day, T.LongType())])).parquet(self.root)

    def rows(self) -> DataFrame:
        """The rows under plain names, with ``_day``."""
        found = self.files()
        if found is None:
            found = self.spark.createDataFrame([], T.StructType([*self.like.fields, T.StructField(self.day, T.LongType())]))
        return found.toDF(*self.names, "_day")

    def write(self, rows: DataFrame, path: str) -> None:
        """Plain ``rows`` with ``_day`` as day directories of files named in order; each task writes one file."""
        order = [self.sold, self.key]
        done, files = numbered(rows, order, self.file_rows, "layout")
        if not files:
            fs, p = _files(self.spark, path)
            fs.mkdirs(p)
            return
        one = done.repartitionById(files, F.col("_file").cast("int")).sortWithinPartitions("_day", *order)
        one.select(*self.names, "_day").toDF(*self.like.names, self.day).write.partitionBy(self.day).option("maxRecordsPerFile", 0).parquet(path)

    def start(self, rows: DataFrame) -> None:
        """The first layout, below a folder that is new."""
        kept = latest(self.plain(rows), self.key, self.arrived)
        self.write(kept.withColumn("_day", day_of(kept, self.sold)), self.root)

    def overwrite(self, late: DataFrame) -> list[int]:
        """Brings late rows in; the days whose files were written anew.

        A late row is kept if it arrived after the layout's row of its key (a null time
        never does, an equal one neither). Days touched are those of kept late rows and
        those where their keys stood; only these are read back whole, joined, sorted and
        staged, then renamed into place. The number of days, not of rows, reaches the
        driver. What an earlier call left half done is finished or dropped first.
        """
        self.recover()
        standing = self.rows()
        new = latest(self.plain(late), self.key, self.arrived)
        new = new.withColumn("_day", day_of(new, self.sold))
        old = standing.select(F.col(self.key).alias("_key"), F.col(self.arrived).alias("_had"), F.col("_day").alias("_stood"))
        met = new.join(old, F.col(self.key).eqNullSafe(F.col("_key")), "left")
        newer = F.col("_stood").isNull() | (F.col(self.arrived) > F.col("_had")) | (F.col(self.arrived).isNotNull() & F.col("_had").isNull())
        kept = written(met.filter(newer).drop("_key", "_had"), "late")
        touched = kept.select(F.explode(F.array("_day", "_stood")).alias("day")).filter("day IS NOT NULL").distinct()
        days = sorted(r["day"] for r in touched.collect())
        if not days:
            return []
        # the keys of kept late rows go by a join, however many they are
        rest = standing.filter(F.col("_day").isin(days)).join(kept.select(F.col(self.key).alias("_gone")), F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
        self.write(rest.unionByName(kept.drop("_stood")), f"{self.root}/{STAGED}")
        self._mark(days)
        self.publish()
        return days

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _mark(self, days: list[int]) -> None:
        """Marks the stage as whole: folders named after the days to be replaced, then ``_ready``."""
        fs, _ = _files(self.spark, self.root)
        for d in days:
            fs.mkdirs(self._path(STAGED, "_days", f"{self.day}={d}"))
        fs.mkdirs(self._path(STAGED, "_ready"))

    def recover(self) -> None:
        """Finishes a publication that broke off; a stage that was not whole is dropped, as nothing was moved."""
        fs, _ = _files(self.spark, self.root)
        if fs.exists(self._path(STAGED, "_ready")):
            self.publish()
        fs.delete(self._path(STAGED), True)
        fs.delete(self._path(ASIDE), True)

    def publish(self) -> None:
        """Puts staged day directories in place of the old ones; a day with none staged goes.

        Each old directory is renamed aside, then the new one renamed in. Called again
        after a crash it carries on: a day that left the stage and has a directory is done.
        """
        fs, _ = _files(self.spark, self.root)
        fs.mkdirs(self._path(ASIDE))
        staged = set(self.days(f"/{STAGED}"))
        for name in sorted(self.days(f"/{STAGED}/_days")):
            live, new, gone = self._path(name), self._path(STAGED, name), self._path(ASIDE, name)
            if fs.exists(live) and not fs.exists(gone):
                _must(fs.rename(live, gone), name)
            if name in staged:
                _must(fs.rename(new, live), name)
            fs.delete(self._path(STAGED, "_days", name), True)
        fs.delete(self._path(STAGED), True)
        fs.delete(self._path(ASIDE), True)


def with_copies(sales: DataFrame) -> DataFrame:
    """The contract's changed copies: rows whose h % 3 = 0 on days divisible by 7 come twice, once later with total + 1."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    plus = lambda name, n: F.col(name) + F.make_dt_interval(days=n.cast("int"))
    copy = F.struct(*[{"total": F.col("total") + 1, "sold_at": plus("sold_at", h % 2), "arrived_at": plus("arrived_at", 1 + h % 97)}.get(c, F.col(f"`{c}`")).alias(c) for c in sales.columns])
    twice = (h % 3 == 0) & (day_of(sales, "sold_at") % 7 == 0)
    own = F.struct(*[F.col(f"`{c}`") for c in sales.columns])
    return sales.select(F.explode(F.when(twice, F.array(own, copy)).otherwise(F.array(own))).alias("r")).select("r.*")


def file_report(at: Layout, rewritten: list[int]) -> DataFrame:
    """One row per file, read back: day, place in its day, rows, sums, digests, path, columns.

    A file's rows come to one task in the order of the file and are digested as a stream.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_rows", "cents", "rows_crc")], T.StructField("ids_sha256", T.StringType())])
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lying = at.files()
    if lying is None:
        columns, read = "", at.spark.createDataFrame([], "path string, place long, id string, cents long, crc long")
    else:
        columns = ",".join(c for c in at.spark.read.option("mergeSchema", "true").parquet(at.root).columns if c != at.day)
        meta = lying.metadataColumn("_metadata")
        mark = F.concat_ws(":", text(F.col("sale_id")), text(micros(lying, "sold_at")), text(micros(lying, "arrived_at")))
        cents = F.coalesce(F.floor(100 * F.col("total") + 0.5).cast("long"), F.lit(0).cast("long"))
        read = lying.select(meta["file_path"].alias("path"), meta["row_index"].alias("place"), text(F.col("sale_id")).alias("id"), cents.alias("cents"), F.crc32(mark.cast("binary")).alias("crc"))

    def make():
        held: list = []

        def out():
            path, *sums, sha = held
            return [pa.array([path], pa.string()), *[pa.array([x], pa.int64()) for x in sums], pa.array([sha.hexdigest()], pa.string())]

        def f(batch):
            for path, i, cents, crc in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] != path:
                    yield out()
                    held.clear()
                if not held:
                    held.extend((path, 0, 0, 0, hashlib.sha256()))
                held[4].update((b"," if held[1] else b"") + i.encode())
                held[1] += 1
                held[2] += cents
                held[3] += crc

        def end():
            if held:
                yield out()

        return f, end

    streamed = read.repartition("path").sortWithinPartitions("path", "place").drop("place")
    files = emit_rows(streamed, make, schema, rows=8192)
    files = files.withColumn("day", F.regexp_extract("path", rf"/{at.day}=(-?\d+)/", 1).cast("long"))
    # one row per file; a file's name begins with the number of the task that wrote it
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.regexp_extract("path", r"/part-(\d+)-[^/]*\z", 1).cast("long"))) - 1
    return files.select("day", place.cast("long").alias("file_no"), "n_rows", "cents", "rows_crc", "path", F.lit(columns).alias("columns"), "ids_sha256", F.array_contains(F.lit(rewritten or [None]).cast("array<long>"), F.col("day")).alias("rewritten"))


def late_sales(sales: DataFrame, *, cutoff: str = "2024-04-10 00:00:00", share: int = 700, file_rows: int | None = None) -> DataFrame:
    """The whole contract over ``sales``: first layout, late overwrite, report of the final files.

    Files have ``1 + floor(N / share)`` rows unless given. Rows arrived at or after
    ``cutoff``, or at no known time, are late. A null ``sale_id`` is one sale and gets no
    copy; a layout keeps one row a sale, so equal rows are one; an empty table gives an
    empty layout and report. Extra columns are stored as they come, whatever their names.
    Files stay in a new folder of ``spark.checkpoint.dir``.
    """
    spark = sales.sparkSession
    root = f"{shared_dir(spark)}/groundlake/late-sales-{uuid.uuid4().hex}"
    at = Layout(spark, root, sales.schema, key="sale_id", sold="sold_at", arrived="arrived_at", file_rows=file_rows or 1 + sales.count() // share)
    rows = with_copies(sales)
    early = F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    at.start(rows.filter(early))
    days = at.overwrite(rows.filter(~early))
    return file_report(at, days)
