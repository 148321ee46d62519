"""Interval and as-of operators over source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pattern import matches

#: Longest body searched, and assumed length of a file's last entity (fixed values).
GREP_BODY, DIFF_TAIL = 100, 200


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) from (path, content); numbers start at 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("_p", "line")).select("path", (F.col("_p") + 1).alias("line_no"), "line")


def grep(files: DataFrame, functions: DataFrame, pattern: str) -> DataFrame:
    """(path, name, line_no, line): matching lines inside bodies of functions (path, name, line).

    A body ends before the next function of its file, after ``GREP_BODY`` lines or
    with the file. A file meets the list of its bodies once, and each body takes its
    slice of the lines inside that row: no line is joined with every body.
    """
    order = Window.partitionBy("path").orderBy("line", "name")
    bodies = functions.filter("line >= 1").select("path", "name", "line", F.lead("line").over(order).alias("_next"))
    size = F.least(F.coalesce(F.col("_next") - F.col("line"), F.lit(GREP_BODY)), F.lit(GREP_BODY))
    listed = bodies.withColumn("size", size).groupBy("path").agg(F.collect_list(F.struct("name", "line", "size")).alias("_bodies"))
    met = files.select("path", F.split("content", "\n").alias("_lines")).join(listed, "path")
    taken = F.transform("_bodies", lambda b: F.struct(b["name"].alias("name"), b["line"].alias("start"), F.slice(F.col("_lines"), b["line"], b["size"]).alias("part")))
    rows = met.select("path", F.explode(taken).alias("b")).select("path", F.col("b.name").alias("name"), F.col("b.start").alias("_start"), F.posexplode("b.part").alias("_o", "text"))
    return rows.filter(matches(F.col("text"), pattern)).select("path", "name", (F.col("_start") + F.col("_o")).alias("line_no"), F.col("text").alias("line"))


#: Lines of a diff that one task carries a file's name along.
DIFF_BLOCK = 65_536


def hunks(diff_lines: DataFrame) -> DataFrame:
    """(path, start, end) of added ranges, from (line_no, line) of a unified diff without context."""
    named = F.when(F.col("line").startswith("+++ b/"), F.col("line").substr(F.lit(7), F.length("line")))
    marks = diff_lines.withColumns({"_named": named, "_block": F.floor(F.col("line_no") / DIFF_BLOCK)}).filter(F.col("_named").isNotNull() | F.col("line").startswith("@@ "))
    # The name that a block begins with is the last one of the blocks before it; there is a row for each block.
    lasts = marks.groupBy("_block").agg(F.max_by("_named", F.when(F.col("_named").isNotNull(), F.col("line_no"))).alias("_last"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_block", F.last("_last", True).over(before).alias("_carried"))
    along = Window.partitionBy("_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    current = F.coalesce(F.last("_named", True).over(along), F.col("_carried"))
    found = marks.join(carried, "_block").withColumn("path", current).filter(F.col("line").startswith("@@ "))
    head = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 1).try_cast("int")
    count = F.coalesce(F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 2).try_cast("int"), F.lit(1))
    return found.select("path", head.alias("start"), (head + count - 1).alias("end")).filter("path is not null and start is not null and end >= start")


def changed_entities(ranges: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, name, line): entities (path, name, line) whose body overlaps a changed range of the path."""
    order = Window.partitionBy("path").orderBy("line", "name")
    bodies = entities.select("path", "name", "line", F.coalesce(F.lead("line").over(order) - 1, F.col("line") + DIFF_TAIL).alias("_end"))
    both = bodies.join(ranges, "path").filter((F.col("start") <= F.col("_end")) & (F.col("end") >= F.col("line")))
    return both.select("path", "name", "line").distinct()


def enclosing(references: DataFrame, entities: DataFrame) -> DataFrame:
    """References (path, ref_id, ref_line) with ``name`` of the last entity at or above the line.

    An as-of join by one sort: entities and references of a path are merged by
    line, and the last entity is carried along. Of entities on one line the first name counts.
    """
    starts = entities.groupBy("path", "line").agg(F.min("name").alias("name"))
    marks = starts.select("path", F.col("line").alias("_at"), F.lit(0).alias("_ref"), "name", F.lit(None).cast("long").alias("ref_id"))
    asked = references.select("path", F.col("ref_line").alias("_at"), F.lit(1).alias("_ref"), F.lit(None).cast("string").alias("name"), F.col("ref_id").cast("long").alias("ref_id"))
    along = Window.partitionBy("path").orderBy("_at", "_ref").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(asked).withColumn("name", F.last("name", True).over(along))
    return merged.filter("_ref = 1").select("path", "ref_id", F.col("_at").alias("ref_line"), "name")
