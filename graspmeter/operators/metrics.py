"""File metrics: branch count, nesting depth, complexity score, symbols and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import half_up, line_count, once, regex_hits, unmarked
from graspmeter.operators.classify import with_risk


def file_branch_count(content: Column) -> Column:
    return F.regexp_count(content, F.lit(K.FILE_BRANCH))


def nesting_depth(text: Column, opening: str, closing: str) -> Column:
    """Deepest level of open brackets; a closing bracket at level 0 is ignored.

    Only the runs of equal brackets are folded, not the characters.
    """
    others = "[^" + "".join("\\" + c for c in opening + closing) + "]+"
    brackets = F.regexp_replace(text, others, "")
    same = F.translate(brackets, opening + closing, "(" * len(opening) + ")" * len(closing))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, run: Column) -> Column:
        now = F.when(run.startswith("("), acc["now"] + F.length(run)).otherwise(
            F.greatest(F.lit(0), acc["now"] - F.length(run))
        )
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    runs = F.regexp_extract_all(same, F.lit(r"\(+|\)+"), F.lit(0))
    return F.aggregate(runs, start, step, lambda acc: acc["top"])


def complexity_score(risk: Column, lines: Column, branches: Column, depth: Column) -> Column:
    return F.least(
        F.lit(10),
        half_up(
            risk * 0.4
            + F.least(F.lit(3.0), lines / 200)
            + F.least(F.lit(3.0), branches / 10)
            + F.least(F.lit(2.0), depth / 5)
        ),
    )


def file_metrics(files: DataFrame, risks: DataFrame | None = None) -> DataFrame:
    """Lines, branches, depth and complexity per file; files without content score their risk."""
    if risks is not None:
        files = files.join(risks.select("file_id", "risk_level"), "file_id", "left")
        files = files.withColumn("risk_level", F.coalesce("risk_level", F.lit(1)))
    content = F.col("content")
    out = files.withColumns(
        {
            "line_count": line_count(content),
            "branch_count": file_branch_count(content),
            "nesting_depth": nesting_depth(content, "{(", "})"),
        }
    ).drop("content")
    score = complexity_score(
        F.col("risk_level"), F.col("line_count"), F.col("branch_count"), F.col("nesting_depth")
    )
    return out.withColumn("complexity_score", F.coalesce(score, F.col("risk_level")))


def _symbol_list() -> Column:
    content = F.col("content")

    def rows(pattern: str, groups: int, kind: str, span: int) -> Column:
        hits = regex_hits(content, pattern, *range(1, groups + 1))
        return F.transform(
            hits,
            lambda h: F.struct(
                F.lit(kind).alias("kind"),
                (h["g1"] if groups == 1 else F.concat(h["g1"], h["g2"])).alias("name"),
                h["line"].alias("start_line"),
                (h["line"] + span).alias("end_line"),
            ),
        )

    python = F.concat(
        rows(K.PY_FUNCTION_SYMBOL, 1, "function", K.SYMBOL_SPAN["function"]),
        rows(K.PY_CLASS_SYMBOL, 1, "class", K.SYMBOL_SPAN["py_class"]),
    )
    other = F.concat(
        rows(K.JS_FUNCTION_SYMBOL, 2, "function", K.SYMBOL_SPAN["function"]),
        rows(K.JS_CLASS_SYMBOL, 1, "class", K.SYMBOL_SPAN["js_class"]),
    )
    return F.when(F.col("language") == "python", python).otherwise(other)


_SYMBOLS = once(_symbol_list)


def symbols(files: DataFrame) -> DataFrame:
    """Function and class names by pattern, with the fixed span each kind is given."""
    return unmarked(files).select("file_id", F.explode(_SYMBOLS()).alias("s")).select("file_id", "s.*")


def totals(files: DataFrame, by: list[str]) -> DataFrame:
    """Files, function symbols and critical files per group of file columns (e.g. repository).

    Counted on the file row and summed on the map side: one pass over the corpus, no join.
    """
    n_functions = F.size(F.filter(_SYMBOLS(), lambda s: s["kind"] == "function"))
    rows = with_risk(unmarked(files)).select(
        *by, n_functions.alias("n_functions"), F.col("category").isNotNull().alias("is_critical")
    )
    return rows.groupBy(*by).agg(
        F.count("*").alias("total_files"),
        F.sum("n_functions").alias("total_functions"),
        F.count_if("is_critical").alias("total_critical"),
    )


#: Sizes of the sketches of distinct names: 2 to this power registers, about 1.6 % of error (one deviation).
SKETCH_BITS = 12


def rollup_parts(files: DataFrame, by: list[str]) -> DataFrame:
    """Per group of all ``by`` columns: files, functions, and a sketch of the distinct function names.

    Parts of a corpus (days, repositories) are counted on their own and go on together to
    ``rolled_up``: sums add up, and sketches of names merge without the names.
    """
    names = F.transform(F.filter(_SYMBOLS(), lambda s: s["kind"] == "function"), lambda s: s["name"])
    rows = unmarked(files).select(*by, names.alias("names"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("total_files"), F.sum(F.size("names")).alias("total_functions"))
    named = rows.select(*by, F.explode("names").alias("name"))
    sketches = named.groupBy(*by).agg(F.hll_sketch_agg("name", SKETCH_BITS).alias("sketch"))
    own = [F.col(c).alias(f"__{c}") for c in by]
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return sums.join(sketches.select(*own, "sketch"), same, "left").drop(*[f"__{c}" for c in by])


def rolled_up(parts: DataFrame, by: list[str]) -> DataFrame:
    """Totals of parts over all levels of ``rollup(by)``; ``level`` is how many columns are rolled up.

    ``about_names`` estimates the distinct function names of a level from the merged sketches.
    """
    level = F.bit_count(F.grouping_id(*by)).cast("int")
    merged = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))
    return parts.rollup(*by).agg(
        level.alias("level"), F.sum("total_files").alias("total_files"), F.sum("total_functions").alias("total_functions"), merged.alias("about_names")
    )


def distinct_names(files: DataFrame, by: list[str]) -> DataFrame:
    """The exact number of distinct function names over all levels of ``rollup(by)``; names meet in a shuffle."""
    names = F.transform(F.filter(_SYMBOLS(), lambda s: s["kind"] == "function"), lambda s: s["name"])
    named = unmarked(files).select(*by, F.explode(names).alias("name")).distinct()
    return named.rollup(*by).agg(F.bit_count(F.grouping_id(*by)).cast("int").alias("level"), F.count_distinct("name").alias("names"))
