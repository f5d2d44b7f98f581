"""Braces of files of any length, lexed in parallel.

Whether a brace counts depends on all quotes before it, but only through four states: outside
of quotes, or inside one of three kinds. So a block of text is a table from the state in which
it is entered to the state in which it is left and the change of depth between, and such tables
compose. A file is cut into blocks, the blocks become tables in parallel, composing the tables
gives each block its first state, depth, offset and line, and then the blocks list their braces
in parallel. Braces pair by file and level: within their block first, so that only what a block
leaves open meets those of other blocks.

Quotes count from the beginning of the file. (``code_functions`` tracks them from the beginning
of each function; both agree where the quotes before a function are balanced.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter import constants as K
from graspmeter.functions.text import QUOTED, let, newlines, running_sums, split_lines, unmarked
from graspmeter.functions.text import MARK, mark_hits
from graspmeter.operators.ranges import asof_join
from graspmeter.session import materialize

#: Characters of a block, and blocks whose tables are composed at once. A text has 2 GB at most,
#: so a file has at most some 65,000 blocks and some 130 runs of them.
BLOCK_CHARS, RUN_BLOCKS = 1 << 15, 512
#: Quote that a state is inside of; the first state is outside of quotes.
STATES = ("", '"', "'", "`")
#: A brace or semicolon outside of quotes with all that stands before it; an unclosed quote swallows the rest.
_TOKEN = rf"\G(?:[^{{}};\"'`]++|{QUOTED})*+[{{}};]"
#: What decides neither a state nor a depth: all but braces, quotes and the backslashes before a quote.
_IDLE = r"[^{}\"'`\\]++|\\++(?![\"'`])"
_TABLE = "array<struct<state:int,depth:int>>"


def text_blocks(files: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """``(file_id, block, text)`` of all files with a brace; no block ends with a backslash.

    So an escaped quote never stands at the beginning of a block. The blocks of a file are dealt
    out to all tasks.
    """
    # Java tries a class such as [\s\S] ten times as slowly as a dot.
    pattern = rf"(?s).{{1,{size}}}+(?:(?<=\\).)*+"
    blocks = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    rows = files.where(F.col("content").contains("{")).select("file_id", F.posexplode(blocks).alias("block", "text"))
    return rows.repartition("file_id", "block")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def block_table(text: Column) -> Column:
    """For each state in which a block may be entered: the state in which it is left, and the change of depth."""

    def left(signs: Column, quote: str) -> Column:
        open_text = F.regexp_replace(F.concat(F.lit(quote), signs), QUOTED, " ")

        def judged(rest: Column) -> Column:
            code = F.regexp_extract(rest, "^[^\"'`]*+", 0)
            last = F.substring(rest, F.length(code) + 1, F.lit(1))
            state = F.array_position(F.array(*[F.lit(s) for s in STATES]), last).cast("int") - 1
            return F.struct(state.alias("state"), (_count(code, "{") - _count(code, "}")).alias("depth"))

        return let(open_text, judged)

    return let(F.regexp_replace(text, _IDLE, ""), lambda signs: F.array(*[left(signs, quote) for quote in STATES]))


def _place(state: Column, depth: Column, begin: Column, line: Column) -> Column:
    return F.struct(state.alias("state"), depth.alias("depth"), begin.alias("begin"), line.alias("line"))


def _after(place: Column, table: Column, size: Column, lines: Column) -> Column:
    step = F.get(table, place["state"])
    return _place(step["state"], place["depth"] + step["depth"], place["begin"] + size, place["line"] + lines)


def _composed(blocks: Column) -> Column:
    """The table of a run of blocks."""
    start = [_place(F.lit(s), F.lit(0), F.lit(0), F.lit(0)) for s in range(len(STATES))]
    ends = [
        F.aggregate(blocks, first, lambda at, b: _after(at, b["table"], b["size"], b["lines"]), lambda at: F.struct(at["state"].alias("state"), at["depth"].alias("depth")))
        for first in start
    ]
    return F.array(*ends)


def _places(items: Column, first: Column, key: str) -> Column:
    """Where each item of an ordered list begins, as structs ``(key, place)``."""
    none = F.array().cast(f"array<struct<{key}:int,place:struct<state:int,depth:int,begin:int,line:int>>>")

    def step(acc: Column, item: Column) -> Column:
        here = F.struct(item[key].alias(key), acc["at"].alias("place"))
        after = _after(acc["at"], item["table"], item["size"], item["lines"])
        return F.struct(after.alias("at"), F.concat(acc["found"], F.array(here)).alias("found"))

    return F.aggregate(items, F.struct(first.alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def block_places(tables: DataFrame, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """``(file_id, block, place)``: state, depth, offset and line with which each block begins.

    ``tables`` has ``file_id, block, table, size, lines``. Blocks compose to runs, runs to files.
    """
    block = F.struct("block", "table", "size", "lines")
    runs = tables.groupBy("file_id", F.floor(F.col("block") / run_blocks).cast("int").alias("run")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    runs = runs.withColumns(
        {
            "table": _composed(F.col("blocks")).cast(_TABLE),
            "size": F.aggregate("blocks", F.lit(0), lambda n, b: n + b["size"]),
            "lines": F.aggregate("blocks", F.lit(0), lambda n, b: n + b["lines"]),
        }
    )
    runs = materialize(runs, "runs")
    origin = _place(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("run", "table", "size", "lines")))
    starts = runs.groupBy("file_id").agg(ordered.alias("runs")).select("file_id", F.inline(_places(F.col("runs"), origin, "run")))
    return runs.select("file_id", "run", "blocks").join(starts, ["file_id", "run"]).select("file_id", F.inline(_places(F.col("blocks"), F.col("place"), "block")))


def _listed(text: Column, place: Column) -> Column:
    """Braces and semicolons outside of quotes: ``(kind, at, level, line)`` of each.

    The level of a brace is the depth inside of it.
    """
    quote = F.get(F.array(*[F.lit(s) for s in STATES]), place["state"])
    shift = place["begin"] - F.length(quote)

    def events(tokens: Column) -> Column:
        kinds = F.transform(tokens, lambda t: F.right(t, F.lit(1)))
        ends = running_sums(F.transform(tokens, lambda t: F.length(t)))
        depths = running_sums(F.transform(kinds, lambda k: F.when(k == "{", 1).when(k == "}", -1).otherwise(0)))
        lines = running_sums(F.transform(tokens, lambda t: newlines(t)))
        return F.transform(
            F.arrays_zip(kinds.alias("kind"), ends.alias("end"), depths.alias("depth"), lines.alias("line")),
            lambda r: F.struct(
                r["kind"].alias("kind"),
                (shift + r["end"] - 1).alias("at"),
                (place["depth"] + r["depth"] + F.when(r["kind"] == "}", 1).otherwise(0)).alias("level"),
                (place["line"] + r["line"]).alias("line"),
            ),
        )

    return let(F.regexp_extract_all(F.concat(quote, text), F.lit(_TOKEN), F.lit(0)), events)


def code_marks(files: DataFrame, size: int = BLOCK_CHARS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """``(file_id, block, kind, at, level, line)``: every brace and semicolon outside of quotes, with its offset."""
    text = F.col("text")
    tables = text_blocks(files, size).select(
        "file_id", "block", "text", block_table(text).alias("table"), F.length("text").alias("size"), newlines(text).alias("lines")
    )
    blocks = materialize(tables, "blocks")
    places = block_places(blocks.select("file_id", "block", "table", "size", "lines"), run_blocks)
    found = blocks.select("file_id", "block", "text").join(places, ["file_id", "block"])
    return materialize(found.select("file_id", "block", F.inline(_listed(text, F.col("place")))), "marks")


def paired(marks: DataFrame) -> DataFrame:
    """``(file_id, open_at, close_at, level, open_line, close_line)`` of all braces that are closed.

    At a level opening and closing braces take turns, so a brace pairs with the next one. What a
    block doesn't pair is at most two braces a level; those pair over the whole file.
    """
    braces = marks.where("kind <> ';'")

    def with_next(rows: DataFrame, *keys: str) -> DataFrame:
        other = F.struct(F.col("kind").alias("kind"), F.col("at").alias("at"), F.col("line").alias("line"))
        order = Window.partitionBy("file_id", *keys, "level").orderBy("at")
        return rows.withColumns({"next": F.lead(other).over(order), "before": F.lag("kind").over(order)})

    def pairs(rows: DataFrame) -> DataFrame:
        closed = rows.where("kind = '{' and next.kind = '}'")
        return closed.select(
            "file_id", F.col("at").alias("open_at"), F.col("next.at").alias("close_at"), "level",
            F.col("line").alias("open_line"), F.col("next.line").alias("close_line"),
        )

    inside = with_next(braces, "block")
    last_open, first_close = (F.col("kind") == "{") & F.col("next").isNull(), (F.col("kind") == "}") & F.col("before").isNull()
    loose = inside.where(last_open | first_close).drop("next", "before")
    return pairs(inside).unionByName(pairs(with_next(loose)))


def brace_pairs(files: DataFrame, size: int = BLOCK_CHARS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """The pairs of braces of all files (``file_id``, ``content``). Null and brace-free contents have none."""
    return paired(code_marks(files, size, run_blocks))


def _candidate_places(files: DataFrame) -> DataFrame:
    """``(file_id, rule, start_line, at, column, name)`` of all function candidates by rule."""
    rules = (K.JS_DECLARATION, K.JS_ARROW, K.JS_METHOD)

    def found(rule: int, pattern: str) -> DataFrame:
        marked = mark_hits(F.col("content"), pattern)

        def of_line(line: Column, i: Column) -> Column:
            pieces = F.split(line, MARK, -1)
            return F.transform(
                running_sums(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))),
                lambda column: F.struct(i.alias("start_line"), column.alias("column")),
            )

        pieces = F.split(marked, MARK, -1)
        starts = running_sums(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p)))
        names = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.regexp_extract(p, rf"\A(?:{pattern})", 1))
        hits = F.arrays_zip(starts.alias("at"), F.flatten(F.transform(split_lines(marked), of_line)).alias("place"), names.alias("name"))
        rows = files.where(F.col("content").contains("{")).select("file_id", F.inline(hits))
        return rows.select("file_id", F.lit(rule).alias("rule"), "at", "place.start_line", "place.column", "name")

    both = found(0, rules[0]).unionByName(found(1, rules[1]))
    methods = found(2, rules[2]).where(~F.col("name").isin(K.METHOD_STOP_WORDS) & F.col("name").rlike(r"\A[a-zA-Z_$]"))
    return both.unionByName(methods)


def function_extents(files: DataFrame, size: int = BLOCK_CHARS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """JavaScript functions of files of any length: name, lines, and the offsets of the body's braces.

    A candidate's body begins at the first brace at or behind it, unless a semicolon comes
    first: an as-of join of candidates and marks, so a long file of candidates without bodies
    takes time in proportion to its length. Of candidates of one line the first with a closed
    body counts.
    """
    scripts = unmarked(files).where("language <> 'python'").select("file_id", "content")
    marks = code_marks(scripts, size, run_blocks)
    closed = paired(marks)
    openings = marks.where("kind <> '}'").select("file_id", "at", "kind")
    # Dealing out by ranges reads its input twice, so what takes parsing is written first.
    candidates = materialize(_candidate_places(scripts), "candidates")
    placed = asof_join(candidates, openings, ["file_id"], "at", "at", direction="forward")
    bodies = placed.where("found.kind = '{'").select("file_id", "rule", "start_line", "column", "name", F.col("found.at").alias("open_at"))
    first = F.min_by(F.struct("name", "open_at", "close_at", "close_line"), F.struct("column", "rule")).alias("f")
    return bodies.join(closed, ["file_id", "open_at"]).groupBy("file_id", "start_line").agg(first).select(
        "file_id", "f.name", "start_line", F.col("f.close_line").alias("end_line"), "f.open_at", "f.close_at"
    )
