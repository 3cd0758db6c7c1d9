"""CSV files with quoted line breaks, read by many tasks.

A line break ends a record only outside quotes, and whether a place is outside follows from the number of quotes
before it. So every piece of a file is read for itself: its lines are counted and so are their quotes. Sums of
the pieces before give each line its number and say whether it begins inside quotes; lines inside quotes belong to the
record that began before them. Records are joined from their lines and parsed by Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleflow.functions.text import na_to_null
from ruleflow.sources.comments import CSV_OPTIONS, require_columns
from ruleflow.storage import materialize


def quotes(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit('"'), F.lit("")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, piece, place, line, quotes, opened``: lines end with a line feed only; ``opened`` is 1 where a line begins inside quotes.

    The lines of a piece follow each other in one task, so a running number and sum need no shuffle but that by
    piece; pieces have an even size. Only one row for each piece is summed over pieces.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("place"), quotes(F.col("value")).alias("quotes"),
    )
    stored = materialize(lines, "csv-lines")  # the numbers of one reading
    pieces = stored.groupBy("file", "piece").agg(F.sum("quotes").alias("in_piece"))
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.withColumn("before", F.coalesce(F.sum("in_piece").over(earlier), F.lit(0))).drop("in_piece")
    within = Window.partitionBy("file", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    counted = stored.withColumn("seen", F.coalesce(F.sum("quotes").over(within), F.lit(0)))
    return counted.join(before, ["file", "piece"]).withColumn("opened", (F.col("before") + F.col("seen")) % 2).drop("before", "seen")


def records(lines: DataFrame) -> DataFrame:
    """``file, first, record``: the texts of records, joined from their lines; ``first`` is the place of its first line.

    A record may go on over pieces. In a piece its lines gather under its first line there; what stands before a piece's
    first record is carried to the last record of the pieces before, along one row for each piece.
    """
    begins = F.when(F.col("opened") == 0, F.col("place"))
    upto = Window.partitionBy("file", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = lines.withColumn("first", F.last(begins, ignorenulls=True).over(upto))
    last = owned.groupBy("file", "piece").agg(F.max("first").alias("last"))
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    open_ = last.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    whole = owned.join(open_, ["file", "piece"]).withColumn("first", F.coalesce("first", "carried"))
    gathered = whole.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return gathered.select("file", "first", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))


def read_quoted(spark: SparkSession, path: str, required: Iterable[str] = (), types: Mapping[str, str] | None = None) -> DataFrame:
    """``read_comments`` with one large file split over tasks, whatever line breaks its quotes hold.

    Every file begins with the same header, which must be on one line; files whose header differs are an error. A carriage return
    before a line end is no part of an unquoted field and stays inside quotes. Empty lines between records are left out.
    """
    lines = numbered_lines(spark, path)
    # A file's places begin with its first line.
    begin = lines.filter("piece = 0").groupBy("file").agg(F.min("place").alias("first"))
    headers = begin.join(lines.select("file", F.col("place").alias("first"), "line"), ["file", "first"]).select(F.rtrim(F.col("line"), F.lit("\r")).alias("header")).distinct()
    found = [row["header"] for row in headers.limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{path} has {'several headers' if found else 'no header'}")
    columns = spark.createDataFrame([(found[0],)], "h string").select(F.from_csv("h", F.lit(", ".join(f"_c{i} STRING" for i in range(found[0].count(",") + 1))), parser_options()).alias("c")).first()["c"]
    names = [c for c in columns if c is not None]
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    body = records(lines).join(begin.withColumn("head", F.lit(True)), ["file", "first"], "left_anti")
    text = F.rtrim(F.col("record"), F.lit("\r"))
    parsed = body.filter(text != "").select(F.from_csv(text, F.lit(schema), parser_options()).alias("row")).select("row.*")
    require_columns(parsed, required, path)
    casts = types or {}
    return parsed.select(*[na_to_null(F.col(f"`{c}`")).cast(casts.get(c, "string")).alias(c) for c in parsed.columns])


def parser_options() -> dict[str, str]:
    """A record is one text: its line breaks are data."""
    kept = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    return {**kept, "charToEscapeQuoteEscaping": '"', "multiLine": "true", "lineSep": "\x1e", "maxCharsPerColumn": "-1"}
