"""Function table of a source corpus: one row per function, its facts as nested columns.

Everything here is a column expression on the file row (regular expressions and
higher-order functions), so ``files -> functions`` is a narrow job: no shuffle, and the
facts of a function (calls, returns, try blocks ...) need no join back to it.

Lines are 0-based. A fact in a body counts its lines from the function's first line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import (
    MARK,
    braced_length,
    first_by_key,
    let,
    mark_hits,
    newlines,
    once,
    opening_brace,
    regex_hits,
    split_lines,
    trim,
    unmarked,
    widening,
)
from graspmeter.operators.metrics import nesting_depth

# Pieces (candidate segments or body lines) looked at before the whole rest is tried.
_SEGMENT_STEPS = (8, 512)
_LINE_STEPS = (64, 4096)

_JS_RULES = (K.JS_DECLARATION, K.JS_ARROW, K.JS_METHOD)
_METHOD_RULE = 2


# --- where functions start and end -----------------------------------------------------


def _by_rule(rule: Column, seg: Column, group: int) -> Column:
    picks = [F.regexp_extract(seg, rf"\A(?:{p})", group) for p in _JS_RULES]
    return F.when(rule == 0, picks[0]).when(rule == 1, picks[1]).otherwise(picks[2])


def _cut(marked: Column) -> Column:
    """Marked text as segments (one per hit, the text before the first hit left out) and lines."""
    lines = split_lines(marked)
    places = F.transform(
        lines,
        lambda line, i: F.transform(
            F.array_repeat(i, F.size(F.split(line, MARK, -1)) - 1),
            lambda at, j: F.struct(at.alias("line"), (j + 1).alias("nth")),
        ),
    )
    pieces = F.split(marked, MARK, -1)
    return F.struct(
        F.slice(pieces, F.lit(2), F.size(pieces)).alias("segments"),
        lines.alias("lines"),
        F.flatten(places).alias("places"),
    )


def _js_span(segments: Column, i: Column) -> Column:
    """Source of the function that starts with segment ``i`` and where its body begins."""
    none = F.struct(F.lit(-1).alias("before"), F.lit("").alias("source"))

    def attempt(text: Column, last: bool) -> Column:
        def with_size(before: Column, size: Column) -> Column:
            hit = F.struct(before.alias("before"), F.substring(text, 1, before + size).alias("source"))
            return F.when(size > 0, hit).when(before == -1, none)

        return let(
            opening_brace(text),
            lambda before: let(
                F.when(before >= 0, braced_length(F.substring(text, before + 1, F.length(text)))),
                lambda size: with_size(before, size),
            ),
        )

    return widening(segments, i + 1, "", _SEGMENT_STEPS, attempt, none)


def _column_at(marked_line: Column, nth: Column) -> Column:
    before = F.call_function("substring_index", marked_line, F.lit(MARK), nth)
    return F.length(before) - nth + 1


def _js_rule_functions(cut: Column, rule: Column) -> Column:
    """Candidates of one rule that have a closed body; the first per line."""

    def candidate(seg: Column, i: Column) -> Column:
        place = F.get(cut["places"], i)
        name = _by_rule(rule, seg, 1)
        kept = (rule != _METHOD_RULE) | (
            ~name.isin(K.METHOD_STOP_WORDS) & name.rlike(r"\A[a-zA-Z_$]")
        )
        return F.when(
            kept,
            F.struct(
                place["line"].alias("start_line"),
                place["nth"].alias("nth"),
                name.alias("name"),
                _by_rule(rule, seg, 2).alias("param_text"),
                _js_span(cut["segments"], i).alias("span"),
            ),
        )

    closed = F.filter(
        F.transform(cut["segments"], candidate),
        lambda c: c.isNotNull() & (c["span"]["before"] >= 0),
    )
    return F.transform(
        first_by_key(closed, "start_line"),
        lambda c: F.struct(
            c["start_line"].alias("start_line"),
            _column_at(F.get(cut["lines"], c["start_line"]), c["nth"]).alias("at"),
            rule.alias("rule"),
            c["name"].alias("name"),
            c["param_text"].alias("param_text"),
            F.substring(
                c["span"]["source"],
                c["span"]["before"] + 2,
                F.length(c["span"]["source"]) - c["span"]["before"] - 2,
            ).alias("body"),
            c["span"]["source"].alias("full_source"),
        ),
    )


def _js_functions(content: Column) -> Column:
    marked = F.array(*[mark_hits(content, p) for p in _JS_RULES])
    cuts = F.transform(marked, _cut)
    found = F.flatten(F.transform(cuts, _js_rule_functions))
    # Without an opening brace there is no body to find.
    return F.when(content.contains("{"), first_by_key(F.array_sort(found), "start_line"))


_PY_SOURCE = r"\A[^\n]*+(?:\n(?:[ \t\r\f\x0B][^\n]*+|(?=\n|\z)))*+"


def _py_functions(content: Column) -> Column:
    """Functions at column 0; the body ends before the next line that is not indented."""

    def one(cut: Column) -> Column:
        last = F.size(cut["segments"]) - 1

        def function(seg: Column, i: Column) -> Column:
            # A segment before another one ends in that one's line break.
            own = F.when(i < last, F.substring(seg, F.lit(1), F.length(seg) - 1)).otherwise(seg)
            return let(
                F.regexp_extract(own, _PY_SOURCE, 0),
                lambda source: F.struct(
                    F.get(cut["places"], i)["line"].alias("start_line"),
                    F.lit(0).alias("at"),
                    F.lit(0).alias("rule"),
                    F.regexp_extract(seg, K.PY_FUNCTION, 1).alias("name"),
                    F.regexp_extract(seg, K.PY_FUNCTION, 2).alias("param_text"),
                    F.regexp_extract(source, r"\A[^\n]*\n([\s\S]*)", 1).alias("body"),
                    source.alias("full_source"),
                ),
            )

        return F.transform(cut["segments"], function)

    return let(_cut(mark_hits(content, K.PY_FUNCTION)), one)


def candidates(files: DataFrame, keep_keywords: bool = False) -> DataFrame:
    """JavaScript/TypeScript function candidates by rule, before any body is looked for.

    Method candidates that are reserved words (``if (..) {``) are left out unless asked for.
    """
    marked = F.array(*[mark_hits(F.col("content"), p) for p in _JS_RULES])
    rows = F.transform(
        F.transform(marked, _cut),
        lambda cut, rule: F.transform(
            cut["segments"],
            lambda seg, i: F.struct(
                rule.alias("rule"),
                F.get(cut["places"], i)["line"].alias("line"),
                _by_rule(rule, seg, 1).alias("name"),
                _by_rule(rule, seg, 2).alias("param_text"),
            ),
        ),
    )
    out = (
        unmarked(files)
        .where(F.col("language") != "python")
        .select("file_id", F.explode(F.flatten(rows)).alias("c"))
        .select("file_id", "c.*")
    )
    if keep_keywords:
        return out
    return out.where(
        (F.col("rule") != _METHOD_RULE)
        | (~F.col("name").isin(K.METHOD_STOP_WORDS) & F.col("name").rlike(r"\A[a-zA-Z_$]"))
    )


_FOUND = once(
    lambda: F.when(F.col("language") == "python", _py_functions(F.col("content"))).otherwise(
        _js_functions(F.col("content"))
    )
)


def function_spans(files: DataFrame) -> DataFrame:
    """One row per function: name, lines, parameter text, body and source."""
    found = _FOUND()
    keep = [c for c in files.columns if c != "content"]
    return (
        unmarked(files).select(*keep, F.explode(found).alias("f"))
        .select(
            *keep,
            F.concat_ws("#", "file_id", F.col("f.start_line")).alias("func_id"),
            F.col("f.name").alias("name"),
            F.col("f.start_line").alias("start_line"),
            (F.col("f.start_line") + newlines(F.col("f.full_source"))).alias("end_line"),
            F.col("f.param_text").alias("param_text"),
            F.col("f.body").alias("body"),
            F.col("f.full_source").alias("full_source"),
        )
    )


# --- facts of one function -------------------------------------------------------------


def parameters(param_text: Column) -> Column:
    """Parameter list as ``array<struct<name, type, has_default, is_optional>>``.

    Commas inside ``<> () [] {}`` do not separate parameters.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts")
    )

    def step(acc: Column, ch: Column) -> Column:
        depth = (
            F.when(ch.isin("<", "(", "[", "{"), acc["depth"] + 1)
            .when(ch.isin(">", ")", "]", "}"), F.greatest(F.lit(0), acc["depth"] - 1))
            .otherwise(acc["depth"])
        )
        at = acc["at"] + 1
        cuts = F.when(
            (ch == ",") & (acc["depth"] == 0), F.concat(acc["cuts"], F.array(at))
        ).otherwise(acc["cuts"])
        return F.struct(depth.alias("depth"), at.alias("at"), cuts.alias("cuts"))

    cuts = F.aggregate(F.split(param_text, ""), start, step, lambda acc: acc["cuts"])

    def pieces(at: Column) -> Column:
        return F.transform(
            at,
            lambda a, i: trim(
                F.substring(
                    param_text, a + 1, F.coalesce(F.get(at, i + 1) - 1, F.length(param_text)) - a
                )
            ),
        )

    plain = r"\A(\w+)(\?)?\s*(?::\s*([^=]+?))?\s*(?:=\s*(.+))?\z"
    rest = r"\A\.\.\.(\w+)(?:\s*:\s*(.+))?\z"

    def one(p: Column) -> Column:
        def param(name, kind, has_default, optional):
            return F.struct(
                name.alias("name"),
                F.nullif(trim(kind), F.lit("")).alias("type"),
                has_default.alias("has_default"),
                optional.alias("is_optional"),
            )

        no = F.lit(False)
        has_default = F.regexp_extract(p, plain, 4) != ""
        return (
            F.when(p.rlike(r"\A[{\[]"), param(p, F.lit(""), p.contains("="), no))
            .when(p.rlike(rest), param(F.regexp_extract(p, rest, 1), F.regexp_extract(p, rest, 2), no, no))
            .when(
                p.rlike(plain),
                param(
                    F.regexp_extract(p, plain, 1),
                    F.regexp_extract(p, plain, 3),
                    has_default,
                    (F.regexp_extract(p, plain, 2) == "?") | has_default,
                ),
            )
            .when(
                p.rlike(r"\A\w"), param(F.regexp_extract(p, r"\A(\w+)", 1), F.lit(""), no, no)
            )
        )

    listed = let(cuts, pieces)
    return F.filter(
        F.transform(F.filter(listed, lambda p: p != ""), one), lambda p: p.isNotNull()
    )


_NO_BLOCKS = (
    "array<struct<try_start:int,try_end:int,catch_start:int,catch_end:int,catch_param:string,"
    "catch_body:string,has_rethrow:boolean,has_return:boolean,only_logs:boolean>>"
)


def try_blocks(body: Column, start_line: Column) -> Column:
    """``try {..} catch (x) {..}`` blocks; those that start inside an earlier one are left out."""

    def block(text: Column, last: bool, lines: Column, i: Column) -> Column:
        """Block that starts in the first line of ``text``; null while undecided.

        A catch part that is still open at the end of the body has no text and ends there.
        """
        ending = F.size(lines) - 1 - F.when(F.get(lines, F.size(lines) - 1) == "", 1).otherwise(0)
        brace = F.call_function(
            "locate", F.lit("{"), text, F.instr(text, "try")
        )

        def after_try(rest: Column) -> Column:
            return let(
                braced_length(rest),
                lambda n: F.when(
                    n > 0, with_catch(F.substring(rest, F.lit(1), n), F.substring(rest, n + 1, F.length(rest)))
                ),
            )

        def with_catch(tried: Column, after: Column) -> Column:
            gap = F.get(F.split(after, K.CATCH, 2), F.lit(0))
            head = F.regexp_extract(after, K.CATCH, 0)
            return F.when(
                after.rlike(K.CATCH),
                let(
                    F.struct(
                        tried.alias("tried"),
                        gap.alias("gap"),
                        head.alias("head"),
                        F.substring(after, F.length(gap) + F.length(head) + 1, F.length(after)).alias("tail"),
                    ),
                    with_body,
                ),
            )

        def with_body(s: Column) -> Column:
            opening = F.instr(s["tail"], "{")
            return F.when(
                opening > 0,
                let(
                    braced_length(F.substring(s["tail"], opening, F.length(s["tail"]))),
                    lambda n: finished(s, opening, n) if last else F.when(n > 0, finished(s, opening, n)),
                ),
            )

        def finished(s: Column, opening: Column, n: Column) -> Column:
            lead = newlines(F.substring(text, F.lit(1), brace - 1))
            try_end = i + lead + newlines(s["tried"])
            catch_start = try_end + newlines(s["gap"])
            catch_end = F.when(
                n > 0,
                catch_start + newlines(s["head"]) + newlines(F.substring(s["tail"], F.lit(1), opening + n - 1)),
            ).otherwise(ending)
            return F.struct(
                i.alias("try_start"),
                try_end.alias("try_end"),
                catch_start.alias("catch_start"),
                catch_end.alias("catch_end"),
                F.regexp_extract(s["head"], K.CATCH, 1).alias("catch_param"),
                F.substring(s["tail"], opening + 1, F.greatest(n - 2, F.lit(0))).alias("catch_body"),
            )

        return let(F.substring(text, brace, F.length(text)), after_try)

    def found(lines: Column) -> Column:
        none = F.lit(None)
        starts = F.filter(
            F.transform(lines, lambda line, i: F.when(line.rlike(K.TRY_LINE), i)),
            lambda i: i.isNotNull(),
        )
        blocks = F.filter(
            F.transform(
                starts,
                lambda i: widening(
                    lines, i + 1, "\n", _LINE_STEPS, lambda t, last: block(t, last, lines, i), none
                ),
            ),
            lambda b: b.isNotNull(),
        )
        return let(blocks, taken)

    def taken(blocks: Column) -> Column:
        """A block is taken only if it starts after the end of the one taken before it."""
        none = F.filter(blocks, lambda b: F.lit(False))
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("free_from"), none.alias("taken")),
            lambda acc, b: F.when(
                b["try_start"] >= acc["free_from"],
                F.struct(
                    (b["catch_end"] + 1).alias("free_from"),
                    F.concat(acc["taken"], F.array(b)).alias("taken"),
                ),
            ).otherwise(acc),
            lambda acc: acc["taken"],
        )

    blocks = F.transform(
        let(split_lines(body), found),
        lambda b: F.struct(
            (start_line + b["try_start"]).alias("try_start"),
            (start_line + b["try_end"]).alias("try_end"),
            (start_line + b["catch_start"]).alias("catch_start"),
            (start_line + b["catch_end"]).alias("catch_end"),
            b["catch_param"].alias("catch_param"),
            b["catch_body"].alias("catch_body"),
            b["catch_body"].rlike(r"(?<!\w)throw(?!\w)").alias("has_rethrow"),
            b["catch_body"].rlike(r"(?<!\w)return(?!\w)").alias("has_return"),
            trim(b["catch_body"]).rlike(K.ONLY_LOGS).alias("only_logs"),
        ),
    )
    return F.when(body.rlike(K.TRY_LINE) & body.rlike(K.CATCH), blocks).otherwise(
        F.array().cast(_NO_BLOCKS)
    )


def in_try(line: Column, blocks: Column) -> Column:
    return F.exists(blocks, lambda b: line.between(b["try_start"], b["try_end"]))


def returns(body: Column, start_line: Column) -> Column:
    def valued(h: Column) -> Column:
        expr = trim(h["g1"])
        kind = (
            F.when(expr.isin("", "void 0"), "void")
            .when(expr == "null", "null")
            .when(expr == "undefined", "undefined")
            .when(expr.rlike(K.PROMISE_RETURN), "promise")
            .otherwise("value")
        )
        return F.struct(
            (start_line + h["line"]).alias("line"), expr.alias("expression"), kind.alias("kind")
        )

    bare = F.transform(
        regex_hits(body, K.RETURN_BARE),
        lambda h: F.struct(
            (start_line + h["line"]).alias("line"), F.lit("").alias("expression"), F.lit("void").alias("kind")
        ),
    )
    return F.concat(F.transform(regex_hits(body, K.RETURN_VALUE, 1), valued), bare)


def throws(body: Column, start_line: Column, blocks: Column) -> Column:
    return F.transform(
        regex_hits(body, K.THROW, 1),
        lambda h: F.struct(
            (start_line + h["line"]).alias("line"),
            trim(h["g1"]).alias("expression"),
            in_try(start_line + h["line"], blocks).alias("in_try"),
        ),
    )


def awaits(body: Column, start_line: Column, blocks: Column) -> Column:
    return F.transform(
        regex_hits(body, K.AWAIT, 1),
        lambda h: F.struct(
            (start_line + h["line"]).alias("line"),
            h["g1"].alias("expression"),
            in_try(start_line + h["line"], blocks).alias("in_try"),
        ),
    )


_EXTERNAL = rf"\A(?:{'|'.join(K.EXTERNAL_NAMES)})\.|\.(?:{'|'.join(K.EXTERNAL_NAMES)})"
# Group 1 takes part only when `await` and at most five blanks stand before the call.
_AWAITED_CALL = rf"(?:(?<=((?<!\w)await\s{{1,4}}|await\s{{5}})))?{K.DOTTED_CALL}"


def external_calls(body: Column, start_line: Column, blocks: Column) -> Column:
    outside = F.filter(
        regex_hits(body, _AWAITED_CALL, 1, 2),
        lambda h: F.lower(h["g2"]).rlike(_EXTERNAL) | (F.size(F.split(h["g2"], r"\.")) >= 3),
    )
    return F.transform(
        outside,
        lambda h: F.struct(
            (start_line + h["line"]).alias("line"),
            h["g2"].alias("callee"),
            F.concat(F.substring(h["text"], F.lit(1), F.length(h["text"]) - 1), F.lit(")")).alias("expression"),
            in_try(start_line + h["line"], blocks).alias("in_try"),
            (h["g1"] != "").alias("is_awaited"),
        ),
    )


def branch_count(body: Column) -> Column:
    counts = [F.regexp_count(body, F.lit(p)) for p in K.FUNCTION_BRANCHES]
    return reduce(lambda a, b: a + b, counts)


def null_checked(body: Column, params: Column) -> Column:
    """Names of parameters the body compares with null or undefined, or reads with ``?.``/``??``."""

    def checked(n: Column) -> Column:
        rx = F.concat(
            F.lit(r"if\s*\((?:!\s*"), n, F.lit(r"(?!\w)|"), n,
            F.lit(r"\s*(?:[=!]==\s*(?:null|undefined)|==\s*null)(?!\w))|"), n,
            F.lit(r"\s*(?:\?\?\s|\?\.)|typeof\s+"), n, F.lit(r"\s*===\s*['\"]undefined['\"]"),
        )
        return F.rlike(body, rx)

    names = F.array_distinct(F.transform(params, lambda p: p["name"]))
    return F.filter(names, lambda n: n.rlike(r"\A\w") & body.contains(n) & checked(n))


def _fact_columns() -> dict[str, Column]:
    body, start, blocks = F.col("body"), F.col("start_line"), F.col("try_blocks")
    return {
        "returns": returns(body, start),
        "throws": throws(body, start, blocks),
        "awaits": awaits(body, start, blocks),
        "calls": external_calls(body, start, blocks),
        "branch_count": branch_count(body),
        "nesting_depth": nesting_depth(body, "{", "}"),
        "null_checked": null_checked(body, F.col("parameters")),
    }


_FACTS = once(_fact_columns)
_BASE_FACTS = once(
    lambda: {
        "parameters": parameters(F.col("param_text")),
        "try_blocks": try_blocks(F.col("body"), F.col("start_line")),
    }
)


def functions(files: DataFrame) -> DataFrame:
    """Function table with all facts; ``files`` needs file_id, language and content."""
    return function_spans(files).withColumns(_BASE_FACTS()).withColumns(_FACTS())


def facts(funcs: DataFrame, kind: str) -> DataFrame:
    """One nested list as its own table: parameters, returns, throws, awaits, calls, try_blocks."""
    return funcs.select("file_id", "func_id", F.posexplode(kind).alias("pos", "x")).select(
        "file_id", "func_id", "pos", "x.*"
    )
