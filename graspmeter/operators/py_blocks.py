"""Nested Python functions and classes by indentation.

A block ends before the next line that is indented no deeper than its head: the next smaller
element of a sequence. A file's heads have few different indents, so every line is filed under
those that it ends, and what follows a head in the list of its own indent ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter.functions.text import let, split_lines
from graspmeter.operators.ranges import interval_join
from graspmeter.session import materialize

_HEAD = r"\A[ \t]*(async[ \t]+def|def|class)[ \t]+(\w+)"
_TAB = 8


def indent_width(line: Column) -> Column:
    """Columns before the first other character; a tab goes to the next multiple of eight."""
    blanks = F.regexp_extract(line, r"\A[ \t]*", 0)
    tabbed = F.aggregate(F.split(blanks, ""), F.lit(0), lambda n, c: F.when(c == "\t", n + _TAB - n % _TAB).when(c == " ", n + 1).otherwise(n))
    return F.when(blanks.contains("\t"), tabbed).otherwise(F.length(blanks))


def nested_blocks(files: DataFrame) -> DataFrame:
    """Every ``def``, ``async def`` and ``class`` of the Python files, with its lines and the block around it.

    ``file_id, kind, name, start_line, end_line, indent, depth, parent_line, parent_name,
    parent_kind``; lines count from 0, and blank lines behind a block belong to it. A line that
    only closes a bracket goes on with the line before it, so a head may span lines.
    Text in strings of several lines is taken as it is indented. Null contents have no blocks.
    """
    def head(line: Column) -> Column:
        kind, name = (F.regexp_extract(line, _HEAD, group) for group in (1, 2))
        return F.struct(F.regexp_replace(kind, r"[ \t]+", " ").alias("kind"), name.alias("name"))

    def of_line(line: Column, i: Column) -> Column:
        indent = F.when(~line.rlike(r"\A\s*(?:[)\]}]|\z)"), indent_width(line))
        return F.struct(i.alias("line_no"), indent.alias("indent"), head(line).alias("head"))

    def ends_some(row: Column, before: Column) -> Column:
        """A head, or the first line behind what the line before it has not ended yet."""
        deeper = (before["indent"] > row["indent"]) | ((before["head"]["kind"] != "") & (before["indent"] == row["indent"]))
        return (row["head"]["kind"] != "") | F.coalesce(deeper, F.lit(False))

    def kept(rows: Column) -> Column:
        return F.filter(rows, lambda row, i: ends_some(row, F.get(rows, i - 1)))

    def with_indents(rows: Column) -> Column:
        heads = F.filter(rows, lambda r: r["head"]["kind"] != "")
        return F.struct(rows.alias("lines"), F.array_sort(F.array_distinct(F.transform(heads, lambda r: r["indent"]))).alias("indents"))

    def of_text(text: Column) -> Column:
        rows = let(F.filter(F.transform(text, of_line), lambda r: r["indent"].isNotNull()), kept)
        return F.struct((F.size(text) - 1).alias("last_line"), let(rows, with_indents).alias("found"))

    # Blocks end at few lines, so the others are left out before lines become rows.
    listed = files.where("language = 'python'").select("file_id", let(split_lines(F.col("content")), of_text).alias("f"))
    listed = materialize(listed.select("file_id", "f.last_line", "f.found.*"), "lines")
    filed = listed.select("file_id", "last_line", "indents", F.inline("lines")).select("file_id", "last_line", "indents", "line_no", "indent", "head.*")
    # A line ends the blocks of its own and of deeper indents.
    filed = filed.withColumn("of", F.explode(F.filter("indents", lambda d: d >= F.col("indent"))))
    following = F.lead("line_no").over(Window.partitionBy("file_id", "of").orderBy("line_no"))
    found = filed.withColumn("following", following).where((F.col("kind") != "") & (F.col("of") == F.col("indent")))
    blocks = found.select(
        "file_id", "kind", "name", F.col("line_no").alias("start_line"), F.coalesce(F.col("following") - 1, "last_line").alias("end_line"), "indent"
    )
    blocks = materialize(blocks, "blocks")
    around = blocks.select("file_id", (F.col("start_line") + 1).alias("from"), F.col("end_line").alias("until"), F.struct("start_line", "name", "kind").alias("outer"))
    met = interval_join(blocks.select("file_id", F.col("start_line").alias("at")), around, ["file_id"], "at", "from", "until", width=16)
    outer = met.groupBy("file_id", F.col("at").alias("start_line")).agg(F.max("outer").alias("outer"), F.count(F.lit(1)).cast("int").alias("depth"))
    return blocks.join(outer, ["file_id", "start_line"], "left").select(
        "file_id", "kind", "name", "start_line", "end_line", "indent", F.coalesce("depth", F.lit(0)).alias("depth"),
        F.col("outer.start_line").alias("parent_line"), F.col("outer.name").alias("parent_name"), F.col("outer.kind").alias("parent_kind"),
    )
