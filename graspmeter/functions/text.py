"""Column helpers for source text: lines, regex hits with line numbers, brace spans.

All helpers are pure column expressions that work on one row, so whatever is built
from them stays in the scan stage: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker put in front of a regex hit. A Unicode noncharacter; `clean_text` removes it.
MARK = "\ufffe"
# Characters taken as white space when a line is trimmed.
BLANKS = " \t\n\r\f\u000b"

# A quoted literal ends at the first same quote that has no backslash right before it.
QUOTED = "|".join(rf"{q}(?:[^{q}]++|(?<=\\){q})*+{q}" for q in ('"', "'", "`"))
# Everything up to the first `{`, `;` or unclosed quote, quoted literals skipped.
_BEFORE_BRACE = rf"\A(?:[^{{;\"'`]++|{QUOTED})*+"
# Covering tokens of a braced block; an unclosed quote swallows the rest.
_BLOCK_TOKEN = rf"[^{{}}\"'`]++|[{{}}]|{QUOTED}|[\"'`][\s\S]*+"


def clean_text(text: Column) -> Column:
    """Text as loaded: no byte-order mark, NBSP as space, the marker character removed."""
    no_bom = F.regexp_replace(text, "^\ufeff", "")
    return F.translate(no_bom, "\u00a0" + MARK, "  ")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    return newlines(text) + 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def half_up(value: Column) -> Column:
    """Round a non-negative double half up to an integer."""
    return F.floor(value + 0.5).cast("int")


def unmarked(files: DataFrame) -> DataFrame:
    """Files whose content surely does not hold the marker, for tables not read by us."""
    text = F.col("content")
    return files.withColumn(
        "content", F.when(text.contains(MARK), F.translate(text, MARK, " ")).otherwise(text)
    )


def mark_hits(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, MARK + "$0")


def hit_lines(marked: Column) -> Column:
    """0-based line of every marked hit, in order of occurrence."""
    return F.flatten(
        F.transform(
            split_lines(marked),
            lambda line, i: F.array_repeat(i, F.size(F.split(line, MARK, -1)) - 1),
        )
    )


def regex_hits(text: Column, pattern: str, *groups: int) -> Column:
    """All hits as ``array<struct<line, text, g1, g2..>>`` with 0-based lines.

    ``text`` is the whole hit, ``gN`` the wanted capture group ('' if it did not take part).
    """
    parts = [
        hit_lines(mark_hits(text, pattern)).alias("line"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("text"),
    ]
    parts += [
        F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups
    ]
    return F.arrays_zip(*parts)


def first_by_key(items: Column, key: str) -> Column:
    """Keep the first element per key of an array already sorted by that key."""
    return let(
        items,
        lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x[key] != F.get(xs, i - 1)[key])),
    )


def opening_brace(text: Column) -> Column:
    """Characters before the first ``{``; -1 if a ``;`` comes first; null if undecided.

    Null means the text ended (or a quote stayed open) before either was met.
    """
    def decide(head: Column) -> Column:
        nxt = F.substring(text, F.length(head) + 1, F.lit(1))
        return F.when(nxt == "{", F.length(head)).when(nxt == ";", F.lit(-1))

    return let(F.regexp_extract(text, _BEFORE_BRACE, 0), decide)


def braced_length(text: Column) -> Column:
    """Length of the block that starts ``text`` with ``{``, both braces included.

    Braces in quoted literals do not count. 0 when the block is not closed.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(acc: Column, tok: Column) -> Column:
        depth = acc["depth"] + F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (acc["size"] + F.length(tok)).alias("size"),
                ((tok == "}") & (depth == 0)).alias("closed"),
            )
        )

    tokens = F.regexp_extract_all(text, F.lit(_BLOCK_TOKEN), F.lit(0))
    return F.aggregate(
        tokens, start, step, lambda acc: F.when(acc["closed"], acc["size"]).otherwise(0)
    )


def widening(
    pieces: Column,
    start: Column,
    glue: str,
    sizes: tuple[int, ...],
    attempt: Callable[[Column, bool], Column],
    otherwise: Column,
) -> Column:
    """Try ``attempt`` on a short run of ``pieces`` from ``start`` (1-based), then on longer ones.

    ``attempt(text, last)`` gives null while undecided; ``otherwise`` is the answer if even the
    whole rest leaves it undecided. The last try sees all remaining pieces, so the answer is
    exact; the short tries keep the usual case cheap when a text has very many candidates.
    """

    def tried(text: Column, last: bool) -> Column:
        return let(text, lambda t: attempt(t, last))

    tries = []
    for size in sizes:
        text = F.array_join(F.slice(pieces, start, F.lit(size)), glue)
        tries.append(F.when(F.size(pieces) - start >= size, tried(text, False)))
    rest = F.array_join(F.slice(pieces, start, F.greatest(F.size(pieces), F.lit(1))), glue)
    return F.coalesce(*tries, tried(rest, True), otherwise)


def once(build: Callable[[], Column]) -> Callable[[], Column]:
    """Build a large column expression one time per driver process and hand it out again."""
    kept: dict[int, Column] = {}

    def get() -> Column:
        gateway = id(SparkContext._gateway)
        if gateway not in kept:
            kept.clear()
            kept[gateway] = build()
        return kept[gateway]

    return get


def render(template: str | Column, fields: Column) -> Column:
    """Fill ``{name}`` places of a template from a map column, each value taken as it is."""
    pieces = F.split(F.lit(template) if isinstance(template, str) else template, r"[{}]", -1)
    return F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i % 2 == 0, piece).otherwise(
                F.coalesce(F.element_at(fields, piece), F.lit(""))
            ),
        ),
        "",
    )


#: Numbers that are summed up in one run.
_RUN = 512


def running_sums(values: Column) -> Column:
    """Prefix sums of an integer array: of runs first, then of the runs' sums, as growing an array copies it."""

    def grown(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all"))

        return F.aggregate(items, start, step, lambda acc: acc["all"])

    runs_before_last = F.greatest(F.ceil(F.size(values) / _RUN).cast("int") - 1, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), runs_before_last), lambda k: grown(F.slice(values, k * _RUN + 1, F.lit(_RUN))))

    def shifted(run: Column, by: Column) -> Column:
        return F.transform(run, lambda x: x + by)

    def joined(parts: Column) -> Column:
        upto = grown(F.transform(parts, lambda run: F.coalesce(F.get(run, F.size(run) - 1), F.lit(0))))
        return let(upto, lambda sums: F.flatten(F.transform(parts, lambda run, k: shifted(run, F.coalesce(F.get(sums, k - 1), F.lit(0))))))

    return F.when(F.size(values) <= _RUN, grown(values)).otherwise(let(runs, joined))
