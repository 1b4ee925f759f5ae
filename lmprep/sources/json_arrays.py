"""Files that hold one JSON array of records each, read in parallel whatever their size.

A file is cut at every closing brace, by byte ranges (blocks) as any text. What a brace means depends on all that stands
before it, but a block changes the parser's state in a simple way: it toggles "inside a string" or does not, and adds to the
depth, one number for each of the two states it may start in. Those three numbers per block compose in order to the state at
each block's start. Inside a block the same is done for its pieces. A record ends where a brace outside strings brings the
depth back to that of the array; only a record that crosses blocks is put together from several of them.

The text is shuffled twice, by block and for the order of the result; what crosses blocks is at most two rows for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lmprep.cluster import once


def _in_block() -> WindowSpec:
    return Window.partitionBy("file", "block").orderBy("at")


def _in_file(*order: str) -> WindowSpec:
    return Window.partitionBy("file").orderBy(*order)


def _total_before(column: str | Column, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces up to a closing brace, with the string state at their start and their effect on the depth, each for a block
    that starts outside (0) or inside (1) a string."""
    read = spark.read.option("lineSep", "}").text(path)
    # ids grow along a block: they give the order of its pieces
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        once(F.regexp_replace("value", r"(?s)\\.", "")).alias("bare"),
    ).withColumn("quotes", _count(F.col("bare"), '"'))

    def depth(opened: int) -> Column:
        plain = F.regexp_replace(F.concat(F.lit('"'), "bare") if opened else F.col("bare"), '"[^"]*("|$)', "")
        closes = F.col("quotes") % 2 == opened
        return _count(plain, "{[") - _count(plain, "]") - closes.cast("int")

    # all that is told by the piece alone comes before the windows, so that they move a text once and numbers otherwise
    told = pieces.select("file", "block", "at", "value", "quotes", depth(0).alias("outside"), depth(1).alias("within"))
    inside = told.withColumn("toggled", _total_before("quotes", _in_block()) % 2)
    same = F.col("toggled") == 0
    return inside.select(
        "file", "block", "at", "value", "quotes", "toggled",
        F.when(same, F.col("outside")).otherwise(F.col("within")).alias("depth0"),
        F.when(same, F.col("within")).otherwise(F.col("outside")).alias("depth1"),
    )


def _starts(pieces: DataFrame) -> DataFrame:
    """State at the start of each block, and each file's last block."""
    blocks = pieces.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.sum("depth0").alias("depth0"), F.sum("depth1").alias("depth1")
    )
    along = _in_file("block")
    begun = blocks.withColumn("inside", _total_before("quotes", along) % 2)
    change = F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    return begun.select("file", "block", "inside", _total_before(change, along).alias("level"), F.max("block").over(Window.partitionBy("file")).alias("last"))


def json_array_lines(spark: SparkSession, path: str) -> DataFrame:
    """The records, one per row as ``value``, each on one line, in the order of the files.

    A file that is anything but one array of objects (and white space) raises when the rows are made. Empty files hold no
    records. Line ends between tokens become tabs; a record must fit in a row.
    """
    pieces = _pieces(spark, path)
    state = pieces.join(_starts(pieces), ["file", "block"])
    change = F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    final = (F.col("block") == F.col("last")) & F.lead("at").over(_in_block()).isNull()
    level = F.col("level") + F.sum(change).over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    outside = (F.col("inside") + F.col("toggled") + F.col("quotes")) % 2 == 0
    ended = state.select(
        "file", "block", "at",
        F.when(final, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("text"),
        (outside & (level == 1) & ~final).cast("int").alias("ends"),
    )
    numbered = ended.withColumn("number", _total_before("ends", _in_block()))
    in_order = F.array_sort(F.collect_list(F.struct("at", "text")))["text"]
    parts = numbered.groupBy("file", "block", "number").agg(F.array_join(in_order, "").alias("text"), F.max("ends").alias("ends"))
    middle = parts.where("number > 0 AND ends = 1").withColumn("record", F.lit(1))
    edges = parts.where("number = 0 OR ends = 0").withColumn("record", _total_before("ends", _in_file("block", "number")))
    in_order = F.array_sort(F.collect_list(F.struct("block", "number", "text")))["text"]
    crossing = edges.groupBy("file", "record").agg(
        F.array_join(in_order, "").alias("text"), F.max("ends").alias("ends"), F.min(F.struct("block", "number")).alias("place")
    )

    # before the first record an array opens, before the others there is a comma, behind the last one the array closes
    first, text = F.col("record") == 0, F.col("text")
    lead = F.when(first, text.rlike(r"^\uFEFF?\s*\[\s*\{")).otherwise(text.rlike(r"^\s*,\s*\{"))
    close = F.when(first, text.rlike(r"^\uFEFF?\s*\[\s*\]\s*$")).otherwise(text.rlike(r"^\s*\]\s*$"))
    message = f"{path} holds a file that is not one JSON array of records; use read_json_lines for lines of records"
    right = F.when(F.col("ends") == 1, lead).otherwise(close)
    found = middle.unionByName(crossing.select("*", "place.*").drop("place"))
    place = ["file", "block", "number"]
    checked = found.select(*place, "ends", F.when(right, text).otherwise(F.raise_error(F.lit(message))).alias("text"))
    line = F.translate(F.regexp_replace("text", r"^\uFEFF?\s*[\[,]\s*", ""), "\r\n", "\t\t")
    return checked.select(*place, "ends", line.alias("value")).where("ends = 1 OR value IS NULL").orderBy(*place).select("value")
