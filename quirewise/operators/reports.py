"""Bundles, checks and contracts around summaries and their exports."""

from __future__ import annotations

import os
import re
import shutil
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.columns import extended, map_arrow
from quirewise.functions import dates as D
from quirewise.session import ship

STUDIES = "3"


def standalone_studies(rows: DataFrame, key: str) -> DataFrame:
    """``key, start, end, studies``: for every row, the spans of other rows that are diagnostic studies."""
    listed = rows.where(F.col("category") == STUDIES).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    named = F.transform("_s", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    once = listed.select(key, named.alias("_names"))
    own = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    others = F.array_join(F.array_remove(F.coalesce("_names", F.array().cast("array<string>")), own), ",")
    return rows.join(once, key, "left").select(key, "start", "end", others.alias("studies"))


def bundle_pages(rows: DataFrame, sizes: DataFrame, categories: list[str], key: str = "doc_id") -> DataFrame:
    """``key, place, page``: the pages of the rows of some categories, in order; pages beyond the record are left out.

    An empty set of categories is an error.
    """
    if not categories:
        raise ValueError("no category is asked for")
    kept = rows.where(F.col("category").cast("string").isin(*categories)).join(sizes, key)
    pages = kept.select(key, "idx", "n", F.explode(F.sequence("start", "end")).alias("page")).where("page BETWEEN 1 AND n")
    place = F.row_number().over(Window.partitionBy(key).orderBy("idx", "page"))
    return pages.select(key, place.alias("place"), "page")


def target_pages(rows: DataFrame, summary_pages: Column) -> DataFrame:
    """Rows with the page their title links to, behind the summary's own pages."""
    return rows.withColumn("target_page", summary_pages + F.col("start") - 1)


def page_map_errors(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, error`` of page-map lines: too few columns, a bad date, a category and date that repeat."""
    parts = F.split("line", ",", -1)
    typed = lines.select(key, "line_no", parts.alias("p")).select(
        key, "line_no", F.size("p").alias("n"), F.trim(F.get("p", F.lit(2))).alias("category"), F.trim(F.get("p", F.lit(3))).alias("date")
    )
    repeated = F.count("*").over(Window.partitionBy(key, "n_ok", "category", "date"))
    judged = typed.withColumn("n_ok", F.col("n") >= 4).withColumn("times", repeated)
    error = (
        F.when(~F.col("n_ok"), "columns").when(~D.is_valid(F.col("date")), "date").when((F.col("times") > 1) & (F.col("date") != "-"), "repeated")
    )
    return judged.select(key, "line_no", error.alias("error")).where("error IS NOT NULL")


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as comma-joined lines, nulls empty."""
    return rows.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def retryable_notices(summaries: DataFrame) -> DataFrame:
    """Summaries that only say a span could not be read: no model wrote them and nobody edited them."""
    untouched = F.col("edited_title").isNull() & F.col("edited_text").isNull() & F.col("edited_date").isNull()
    return summaries.where(F.coalesce("unreadable", F.lit(False)) & F.col("model").isNull() & untouched)


def delivered_buckets(human: DataFrame, rows: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, date, bucket``: what became of every date a person lists, and delivered dates nobody lists.

    ``human`` gives ``key, date``; ``rows`` ``key, date, included``; ``texts``
    ``key, text``.
    """
    ours = rows.where("date <> '-'").groupBy(key, "date").agg(F.bool_or("included").alias("shipped"))
    both = human.distinct().withColumn("listed", F.lit(True)).join(ours, [key, "date"], "full").join(texts, key, "left")
    bucket = (
        F.when(F.col("listed") & F.col("shipped"), "delivered")
        .when(F.col("listed") & F.col("shipped").isNotNull(), "excluded")
        .when(F.col("listed") & D.appears(F.col("date"), F.coalesce("text", F.lit(""))), "re_dated")
        .when(F.col("listed"), "unfound")
        .when(F.col("shipped"), "extra")
    )
    return both.select(key, "date", bucket.alias("bucket")).where("bucket IS NOT NULL")


def audited(rows: DataFrame) -> DataFrame:
    """``text, ok`` of an audit's reply: a blank fix keeps the original and is sound; a failed or cut reply is not."""
    fixed = F.trim(F.coalesce("fixed", F.lit("")))
    sound = F.col("error").isNull() & ~F.coalesce("truncated", F.lit(False))
    others = [c for c in rows.columns if c not in ("original", "fixed", "error", "truncated")]
    return rows.select(*others, F.when(sound & (fixed != ""), F.col("fixed")).otherwise(F.col("original")).alias("text"), sound.alias("ok"))


def insert_row(rows: DataFrame, wanted: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with manual ones added, untitled and flagged; spans beyond the record are refused."""
    good = wanted.join(sizes, key).where("1 <= start AND start <= end AND end <= n")
    made = good.select(
        key, "start", "end", F.lit("100").alias("category"), F.lit("(added manually)").alias("title"), F.lit("x").alias("flag")
    )
    return rows.select(key, "start", "end", "category", "title", "flag").unionByName(made)


def safe_names(rows: DataFrame, column: str, fallback: str = "file") -> DataFrame:
    """Rows with a file name in plain ASCII: letters lose their marks, which no built-in function does."""
    ship(rows.sparkSession)
    schema = extended(rows.schema)

    def plain(text: str | None) -> str:
        ascii_text = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().replace("/", " ").replace("\\", " ")
        name = "".join(c for c in "_".join(ascii_text.split()) if c.isalnum() or c in "_.-").strip("._")
        return name or fallback

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[column] = pa.array([plain(t) for t in columns[column].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_arrow(rows, run, schema)


def all_or_abort(rows: DataFrame, ok: Column) -> DataFrame:
    """The rows that succeeded, or none where every row failed: a backfill that only fails must not be kept."""
    facts = rows.agg(F.count_if(ok).alias("_good"))
    return rows.where(ok).join(F.broadcast(facts), F.col("_good") > 0).drop("_good")  # one row


def category_total(rows: DataFrame, key: str, category: str) -> DataFrame:
    """``key, n``: the rows of one category in each record, none counting 0."""
    return rows.groupBy(key).agg(F.count_if(F.col("category") == category).alias("n"))


#: Sentences of a report that a reader knows it by; fixed values.
REVIEW_TITLE = "Medical Record Review"
SUMMARY_INTRO = "The following is a summary of those records:"
CONCLUSION = "This concludes the review of submitted records."


def report_lines(heads: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """``key, part, at, line``: the lines of each record's chronological report, in the order of ``part`` and ``at``.

    ``heads`` gives ``key, name, born, kind, intro``, one row a record; ``entries``
    ``key, date, title, text`` and ``order``.  Header, kind of review, title, intro
    and lead come first, then the entries, undated ones first, then by date, of
    equal ones by ``order``, and a conclusion.  A line break within a text becomes
    a blank.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    opening = [F.concat(F.lit("RE: "), flat("name")), flat("born"), F.coalesce(F.nullif(flat("kind"), F.lit("")), F.lit(" ")), F.lit(REVIEW_TITLE), flat("intro"), F.lit(SUMMARY_INTRO)]
    top = heads.select(key, F.lit(0).alias("part"), F.posexplode(F.array(*opening)).alias("_n", "line"))
    first = top.select(key, "part", F.struct(F.lit(None).cast("date").alias("day"), F.col("_n").cast("bigint").alias("n")).alias("at"), "line")
    line = F.concat(flat("date"), F.lit("\t"), flat("title"), F.lit(": "), flat("text"))
    place = F.struct(D.parse(F.col("date")).alias("day"), F.col(order).cast("bigint").alias("n"))
    middle = entries.select(key, F.lit(1).alias("part"), place.alias("at"), line.alias("line"))
    last = heads.select(key, F.lit(2).alias("part"), F.struct(F.lit(None).cast("date").alias("day"), F.lit(0).cast("bigint").alias("n")).alias("at"), F.lit(CONCLUSION).alias("line"))
    return first.unionByName(middle).unionByName(last)


#: Folders that the reports' own folders are dealt over, so that no folder is listed by one task alone.
BUCKETS = 1024
#: Tasks that read reports back; each opens its files one after the other.
READERS = 256
#: Lines that a reading task holds at a time.
LINES = 5000
_LINE_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
#: What Spark escapes in a folder's name, and the folder of null and of the empty string.
_ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_reports(lines: DataFrame, key: str, path: str) -> None:
    """Each record's lines as one text file in a folder of its own, in order: ``bucket=B/record=K/*.txt``.

    A record's lines pass sorted through one task, which holds none of them.  The
    files appear when the whole job is done, and a task that is run again replaces
    what it wrote, so no line is there twice.  In a folder of the machines' own file
    system tasks write the files themselves, as Hadoop starts a process for each
    file that it creates there; in other stores Spark's writer does it.
    """
    # Null and the empty string share a folder, as Spark has it; never null, so that the writer does not sort anew.
    record = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(_NO_NAME))
    named = lines.select(F.pmod(F.xxhash64(record), F.lit(BUCKETS)).alias("bucket"), record.alias("record"), F.col(key).alias("key"), "part", "at", F.col("line").alias("value"))
    dealt = named.repartition("record").sortWithinPartitions("bucket", "record", "key", "part", "at").select("bucket", "record", "value")
    folder = _plain_folder(lines.sparkSession, path)
    if folder is None:
        dealt.write.mode("overwrite").partitionBy("bucket", "record").text(path)
    else:
        _write_files(dealt, folder)


def _plain_folder(spark, path: str) -> str | None:
    """The folder that ``path`` names where it is in the machines' own file system."""
    parts = urlsplit(path)
    scheme = parts.scheme or urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    return os.path.abspath(parts.path if parts.scheme else path) if scheme == "file" else None


def _folder_name(record: str) -> str:
    """The folder's name as Spark's writer would have it."""
    return "record=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", record)


def _write_files(rows: DataFrame, folder: str) -> None:
    """``bucket, record, value`` rows that are sorted by record in each part, as files; the folder is put in place when all are written."""
    ship(rows.sparkSession)
    staged = f"{folder}-{uuid.uuid4().hex}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, mark = None, None, uuid.uuid4().hex  # what another attempt at this task writes has another mark
        for batch in batches:
            for bucket, record, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{staged}/bucket={bucket}/{_folder_name(record)}"
                if at != name:
                    if out is not None:
                        out.close()
                        os.replace(out.name, f"{name}/report.txt")
                    os.makedirs(at, exist_ok=True)
                    name, out = at, open(f"{at}/report.{mark}", "wb")  # noqa: SIM115
                out.write((value or "").encode() + b"\n")
        if out is not None:
            out.close()
            os.replace(out.name, f"{name}/report.txt")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    os.makedirs(staged)
    try:
        rows.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
        if os.path.isdir(folder):
            shutil.rmtree(folder)
        os.replace(staged, folder)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def read_reports(spark, path: str) -> DataFrame:
    """``record, file, n_files, n, line``: the lines of written reports, numbered from 1 in each file, and how many files its record has.

    In a folder of the machines' own file system tasks list and read the reports
    themselves, so the driver holds nothing of them; in other stores Spark's reader
    does it, whose driver holds a status for each file.
    """
    folder = _plain_folder(spark, path)
    if folder is not None:
        return _read_files(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).coalesce(READERS)
    record = F.regexp_extract("path", "record=([^/]*)/", 1)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\n$", "")
    counted = files.select(record.alias("record"), F.col("path").alias("file"), text.alias("text")).withColumn("n_files", F.count("*").over(Window.partitionBy("record")))
    return counted.select("record", "file", "n_files", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _read_files(spark, folder: str) -> DataFrame:
    """The lines of reports, by tasks that list some of the folders that records are dealt over; a record's files are all in one."""
    ship(spark)
    names = ["record", "file", "n_files", "n", "line"]

    def lines(bucket: int) -> Iterator[tuple]:
        at = f"{folder}/bucket={bucket}"
        for record in sorted(os.listdir(at)) if os.path.isdir(at) else []:
            files = sorted(f for f in os.listdir(f"{at}/{record}") if f.endswith(".txt") and f[0] not in "._")
            for file in files:
                with open(f"{at}/{record}/{file}", "rb") as text:
                    for n, line in enumerate(text, start=1):
                        yield record.removeprefix("record="), f"file:{at}/{record}/{file}", len(files), n, line.removesuffix(b"\n").decode(errors="replace")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                every = lines(bucket)
                while some := list(islice(every, LINES)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _LINE_TYPES, strict=True)], names=names)

    return spark.range(0, BUCKETS, 1, READERS).mapInArrow(run, "record string, file string, n_files bigint, n int, line string")
