"""Twelve anti-pattern rules over the function table.

A rule is a column expression on one function row that gives an array of findings. All
rules together are evaluated in one pass and exploded once: the findings of a corpus are
one narrow job over its files, without a shuffle or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import (
    MARK,
    first_by_key,
    let,
    mark_hits,
    newlines,
    once,
    regex_hits,
    render,
    split_lines,
    trim,
    unmarked,
)
from graspmeter.operators.code_functions import functions
from graspmeter.rule_texts import RULES

RULE_NAMES = list(RULES)


def _evidence(**values: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
            for k, v in values.items()
        ]
    )


def _finding(line: Column, nth: Column, evidence: Column, end_line: Column | None = None) -> Column:
    end = F.lit(None).cast("int") if end_line is None else end_line
    return F.struct(
        line.cast("int").alias("line"), nth.cast("int").alias("nth"), end.alias("end_line"), evidence.alias("evidence")
    )


def _none() -> Column:
    """An empty list of findings."""
    one = _finding(F.lit(0), F.lit(0), _evidence(kind=F.lit("")))
    return F.slice(F.array(one), 1, 0)


def _operation_in(block: Column) -> Column:
    """First external call inside the try part, else the first await, else a generic phrase."""

    def first_in(items: str) -> Column:
        inside = F.filter(items, lambda c: c["line"].between(block["try_start"], block["try_end"]))
        return F.get(inside, F.lit(0))["expression"]

    return F.coalesce(first_in("calls"), first_in("awaits"), F.lit("the operation"))


# --- rules, in detector order -----------------------------------------------------------


def _missing_error_handling() -> Column:
    def nearest(call: Column) -> Column:
        by_distance = F.transform(
            "try_blocks",
            lambda b, i: F.struct(
                F.abs(b["try_start"] - call["line"]).alias("gap"), i.alias("i"), b["try_start"].alias("at")
            ),
        )
        return F.array_min(by_distance)["at"]

    return F.transform(
        F.filter(
            F.transform("calls", lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
            lambda x: ~x["c"]["in_try"],
        ),
        lambda x: _finding(
            x["c"]["line"],
            x["i"],
            _evidence(
                kind=F.lit("missing_error_handling"),
                callee=x["c"]["callee"],
                external_call=x["c"]["expression"],
                is_async=x["c"]["is_awaited"],
                nearest_try_catch=nearest(x["c"]),
            ),
        ),
    )


def _silent_catch() -> Column:
    return F.transform(
        F.filter("try_blocks", lambda b: b["only_logs"] & ~b["has_rethrow"] & ~b["has_return"]),
        lambda b, i: _finding(
            b["catch_start"],
            i,
            _evidence(
                kind=F.lit("silent_catch"),
                try_start_line=b["try_start"],
                catch_body=b["catch_body"],
                operation_in_try=_operation_in(b),
            ),
            b["catch_end"],
        ),
    )


def _unchecked_parameter() -> Column:
    body, start = F.col("body"), F.col("start_line")

    def usage(name: Column) -> Column:
        """Line and text of the first member access, else of the first mention."""
        member = F.concat(F.lit(r"(?<!\w)"), name, F.lit(r"(?!\w)(?:\.[\w]+|\[)"))
        mention = F.concat(F.lit(r"(?<!\w)"), name, F.lit(r"(?!\w)"))

        def hit(rx: Column) -> Column:
            return F.when(
                F.rlike(body, rx),
                F.struct(
                    (start + newlines(F.get(F.split(body, rx, 2), F.lit(0)))).alias("line"),
                    F.regexp_extract_all(body, rx, F.lit(0))[0].alias("text"),
                ),
            )

        return F.when(
            body.contains(name),
            F.coalesce(hit(member), hit(mention)),
        )

    unchecked = F.filter(
        "parameters",
        lambda p: ~p["has_default"]
        & ~p["is_optional"]
        & (p["name"] != "_")
        & p["name"].rlike(r"\A\w")
        & ~p["name"].isin(K.FRAMEWORK_PARAMS)
        & ~F.array_contains("null_checked", p["name"]),
    )

    def found(p: Column, i: Column) -> Column:
        return let(
            F.coalesce(usage(p["name"]), F.struct(start.alias("line"), p["name"].alias("text"))),
            lambda u: _finding(
                u["line"],
                i,
                _evidence(
                    kind=F.lit("unchecked_parameter"),
                    parameter=p["name"],
                    parameter_type=p["type"],
                    usage=u["text"],
                    has_type_check=F.rlike(body, F.concat(F.lit(r"typeof\s+"), p["name"])),
                ),
            ),
        )

    busy = (F.size("calls") > 0) | (F.size("returns") > 0)
    return F.when(busy, F.transform(unchecked, found)).otherwise(_none())


def _unhandled_async() -> Column:
    outside = F.filter(
        F.transform("awaits", lambda a, i: F.struct(a.alias("a"), i.alias("i"))),
        lambda x: ~x["a"]["in_try"],
    )
    rows = F.transform(
        outside,
        lambda x: _finding(
            x["a"]["line"],
            x["i"],
            _evidence(
                kind=F.lit("unhandled_async"),
                async_call=x["a"]["expression"],
                has_catch_chain=x["a"]["expression"].rlike(r"\.catch\s*\("),
            ),
        ),
    )
    return F.when(F.size("calls") > 0, rows).otherwise(_none())


def _inconsistent_return() -> Column:
    kinds = F.array_distinct(F.transform("returns", lambda r: r["kind"]))
    mixed = (
        (F.size("returns") >= 2)
        & F.array_contains(kinds, "value")
        & F.arrays_overlap(kinds, F.array(F.lit("null"), F.lit("undefined")))
    )
    listed = F.transform(
        "returns", lambda r: F.concat_ws(" ", r["line"].cast("string"), r["kind"], r["expression"])
    )
    one = _finding(
        F.col("start_line"),
        F.lit(0),
        _evidence(
            kind=F.lit("inconsistent_return"),
            types=F.array_join(kinds, ", "),
            returns=F.array_join(listed, "\n"),
        ),
    )
    return F.when(mixed, F.array(one)).otherwise(_none())


def secret_hits(content: Column) -> Column:
    """Literal credentials in a text: ``array<struct<line, nth, secret_type, variable, preview>>``.

    The same text on one line counts once.
    """

    def rows(pattern: str, base: str, no: int) -> Column:
        def kind(text: Column) -> Column:
            low = F.lower(text)
            picks = [F.when(low.rlike(rx), F.lit(name)) for rx, name in K.SECRET_KINDS]
            return F.coalesce(*picks, F.lit(base))

        return F.transform(
            regex_hits(content, pattern),
            lambda h, i: F.struct(
                F.struct(h["line"].alias("line"), h["text"].alias("text")).alias("key"),
                F.struct(F.lit(no).alias("rule"), i.alias("i")).alias("nth"),
                h["line"].alias("line"),
                kind(h["text"]).alias("secret_type"),
                F.coalesce(
                    F.nullif(F.regexp_extract(h["text"], r"['\"]([^'\"]+)['\"]", 1), F.lit("")), h["text"]
                ).alias("value"),
            ),
        )

    hits = F.concat(*[rows(p, base, no) for no, (p, base) in enumerate(K.SECRETS)])
    kept = F.array_sort(
        F.transform(
            first_by_key(F.array_sort(hits), "key"),
            lambda h: F.struct(h["nth"], h["line"], h["secret_type"], h["value"]),
        )
    )

    def described(lines: Column, found: Column) -> Column:
        return F.transform(
            found,
            lambda h, i: F.struct(
                h["line"].alias("line"),
                i.alias("nth"),
                h["secret_type"].alias("secret_type"),
                F.coalesce(
                    F.nullif(F.regexp_extract(F.get(lines, h["line"]), K.SECRET_VARIABLE, 1), F.lit("")),
                    F.lit("unknown"),
                ).alias("variable"),
                F.concat(F.substring(h["value"], 1, 4), F.lit("...")).alias("preview"),
            ),
        )

    return let(kept, lambda found: let(split_lines(content), lambda lines: described(lines, found)))


def _hardcoded_secret() -> Column:
    return F.transform(
        "secrets",
        lambda s: _finding(
            s["line"],
            s["nth"],
            _evidence(
                kind=F.lit("hardcoded_secret"),
                secret_type=s["secret_type"],
                variable=s["variable"],
                partial_value=s["preview"],
            ),
        ),
    )


def _sql_injection() -> Column:
    body, start = F.col("body"), F.col("start_line")

    def rows(lines: Column) -> Column:
        return F.transform(
            first_by_key(regex_hits(body, K.SQL_CALL), "line"),
            lambda h, i: _finding(
                start + h["line"],
                i,
                _evidence(
                    kind=F.lit("sql_injection"),
                    query=trim(F.get(lines, h["line"])),
                    variable=F.coalesce(
                        F.nullif(F.regexp_extract(h["text"], r"\$\{([^}]+)\}", 1), F.lit("")),
                        F.lit("user_input"),
                    ),
                ),
            ),
        )

    return F.when(body.rlike(K.SQL_CALL), let(split_lines(body), rows)).otherwise(_none())


def _missing_input_validation() -> Column:
    body = F.col("body")
    validated = F.exists(
        F.array(*[F.lit(w) for w in K.VALIDATION_WORDS]), lambda w: body.contains(w)
    )
    first = F.col("start_line") + newlines(F.get(F.split(body, K.REQUEST_DATA, 2), F.lit(0)))
    one = _finding(
        first,
        F.lit(0),
        _evidence(
            kind=F.lit("generic"),
            details=F.lit(
                "req.body/params/query used without schema validation. "
                "No zod/joi/yup/express-validator found in function body."
            ),
        ),
    )
    return F.when(body.rlike(K.REQUEST_DATA) & ~validated, F.array(one)).otherwise(_none())


def _error_swallowing() -> Column:
    return F.transform(
        F.filter(
            "try_blocks",
            lambda b: (trim(b["catch_body"]) == "") | b["catch_body"].rlike(K.ONLY_COMMENTS),
        ),
        lambda b, i: _finding(
            b["catch_start"],
            i,
            _evidence(
                kind=F.lit("silent_catch"),
                try_start_line=b["try_start"],
                catch_body=b["catch_body"],
                operation_in_try=_operation_in(b),
            ),
            b["catch_end"],
        ),
    )


def _exposed_internal_error() -> Column:
    def leak_line(b: Column) -> Column:
        sends = F.transform(split_lines(b["catch_body"]), lambda line: line.rlike(K.RESPONSE_SEND))
        return b["catch_start"] + F.greatest(F.array_position(sends, True) - 1, F.lit(0))

    return F.transform(
        F.filter(
            "try_blocks",
            lambda b: b["catch_body"].rlike(K.RESPONSE_SEND) & b["catch_body"].rlike(K.ERROR_DETAIL),
        ),
        lambda b, i: _finding(
            leak_line(b),
            i,
            _evidence(
                kind=F.lit("generic"),
                catch_line_1=b["catch_start"] + 1,
                details=F.lit(
                    "catch block sends err.message/err.stack or String(err) in HTTP response "
                    "via res.json/send/status."
                ),
            ),
            b["catch_end"],
        ),
    )


def _dead_code() -> Column:
    body, start = F.col("body"), F.col("start_line")

    def reasons(text: Column) -> Column:
        return F.when(text.rlike(r"(?<!\w)return(?!\w)"), "return statement").when(
            text.rlike(r"(?<!\w)throw(?!\w)"), "throw statement"
        )

    def rows(lines: Column) -> Column:
        solid = F.filter(
            F.transform(
                lines,
                lambda line, i: let(
                    trim(line),
                    lambda t: F.struct(
                        i.alias("i"),
                        t.alias("text"),
                        t.rlike(r"\A(?://|\*|/\*)").alias("is_comment"),
                        reasons(t).alias("reason"),
                    ),
                ),
            ),
            lambda x: x["text"] != "",
        )
        # Only lines up to a comment that itself says return/throw need a look further ahead.
        nothing = F.struct(F.lit(-1).alias("i"), F.lit("").alias("reason"))
        start_state = F.struct(
            nothing.alias("open"),
            F.slice(F.array(_dead(F.lit(0), F.lit(""), nothing)), 1, 0).alias("found"),
        )

        def step(acc: Column, x: Column) -> Column:
            waiting = acc["open"]["i"] >= 0
            hit = waiting & ~x["is_comment"] & ~x["text"].isin("}", "};")
            found = F.when(
                hit, F.concat(acc["found"], F.array(_dead(x["i"], x["text"], acc["open"])))
            ).otherwise(acc["found"])
            own = F.struct(x["i"].alias("i"), x["reason"].alias("reason"))
            after = (
                F.when(waiting & x["is_comment"], acc["open"])
                .when(x["reason"].isNotNull(), own)
                .otherwise(nothing)
            )
            return F.struct(after.alias("open"), found.alias("found"))

        return F.aggregate(solid, start_state, step, lambda acc: acc["found"])

    found = F.transform(
        let(split_lines(body), rows),
        lambda d, i: _finding(
            start + d["i"],
            i,
            _evidence(
                kind=F.lit("dead_code"),
                reason=d["reason"],
                reason_line_1=start + d["reason_at"] + 1,
                dead_code_source=d["text"],
            ),
        ),
    )
    return F.when(body.rlike(r"(?<!\w)(?:return|throw)(?!\w)"), found).otherwise(_none())


def _dead(at: Column, text: Column, cause: Column) -> Column:
    return F.struct(
        at.alias("i"), text.alias("text"), cause["i"].alias("reason_at"), cause["reason"].alias("reason")
    )


_ASYNC_CALLEE = "|".join(n.replace(".", r"\.") for n in K.KNOWN_ASYNC)
# Words of a body, and the marks in front of assigned calls.
_WORD_OR_MARK = MARK + r"|\w+"


def _missing_await() -> Column:
    """One pass lists the words of the body with their lines; a kept call looks for its name behind it."""
    body, start = F.col("body"), F.col("start_line")

    def words_of(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(_WORD_OR_MARK), F.lit(0))

    def rows(lines: Column, words: Column, word_lines: Column) -> Column:
        marks = F.filter(F.transform(words, lambda w, i: F.when(w == MARK, i)), lambda i: i.isNotNull())
        calls = F.transform(
            F.arrays_zip(regex_hits(body, K.ASSIGNED_CALL, 1, 2).alias("hit"), marks.alias("at")),
            lambda c: F.struct(
                c["hit"]["line"].alias("line"), c["hit"]["g1"].alias("name"), c["hit"]["g2"].alias("callee"),
                (c["at"] + F.size(words_of(c["hit"]["text"]))).alias("last_word"),
            ),
        )
        known = F.filter(calls, lambda c: F.lower(c["callee"]).rlike(_ASYNC_CALLEE))

        def used_on(call: Column) -> Column:
            behind = F.array_position(F.slice(words, call["last_word"] + 2, F.size(words)), call["name"]).cast("int")
            return F.when(behind > 0, start + F.get(word_lines, call["last_word"] + behind))

        return F.transform(
            known,
            lambda c, i: _finding(
                start + c["line"],
                i,
                _evidence(
                    kind=F.lit("missing_await"),
                    async_call=c["callee"],
                    function_is_async=F.substring_index("full_source", "\n", 1).rlike(r"(?<!\w)async(?!\w)"),
                    result_used_on_line=used_on(c),
                    line_text=trim(F.get(lines, c["line"])),
                ),
            ),
        )

    def word_lines(marked: Column) -> Column:
        return F.flatten(F.transform(split_lines(marked), lambda line, i: F.array_repeat(i, F.size(words_of(line)))))

    found = let(
        mark_hits(body, K.ASSIGNED_CALL),
        lambda marked: let(
            words_of(marked),
            lambda words: let(
                word_lines(marked), lambda at: let(split_lines(body), lambda lines: rows(lines, words, at))
            ),
        ),
    )
    return F.when(body.rlike(K.ASSIGNED_CALL), found).otherwise(_none())


_DETECTORS = {
    name: once(build)
    for name, build in zip(
        RULE_NAMES,
        (
            _missing_error_handling,
            _silent_catch,
            _unchecked_parameter,
            _unhandled_async,
            _inconsistent_return,
            _hardcoded_secret,
            _sql_injection,
            _missing_input_validation,
            _error_swallowing,
            _exposed_internal_error,
            _dead_code,
            _missing_await,
        ),
    )
}


def _tagged(name: str) -> Column:
    """Findings of one rule with what decides their order and their identity."""
    no = RULE_NAMES.index(name)
    rank = K.SEVERITY_RANK[RULES[name]["severity"]]
    return F.transform(
        _DETECTORS[name](),
        lambda x: F.struct(
            F.struct(F.lit(no).alias("rule"), x["line"].alias("line")).alias("key"),
            x["nth"].alias("nth"),
            F.lit(rank).alias("rank"),
            x["end_line"].alias("end_line"),
            x["evidence"].alias("evidence"),
        ),
    )


def _untagged(tagged: Column) -> Column:
    return F.transform(
        tagged,
        lambda x: F.struct(x["rank"], x["key"]["rule"].alias("rule"), x["nth"], x["key"]["line"].alias("line"),
                           x["end_line"], x["evidence"]),
    )


_ALL = once(lambda: F.array_sort(_untagged(first_by_key(F.array_sort(F.concat(*[_tagged(n) for n in RULE_NAMES])), "key"))))
_ONE = {n: once(lambda n=n: F.array_sort(_untagged(_tagged(n)))) for n in RULE_NAMES}


def _rule_value(column: str) -> Column:
    """Fixed text of the finding's rule; a twelve-entry map literal, so no join."""
    entries = []
    for name, rule in RULES.items():
        value = rule[column]
        lit = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        entries += [F.lit(name), lit]
    return F.element_at(F.create_map(*entries), F.col("type"))


_RULE_KIND = once(lambda: {c: _rule_value(c) for c in ("severity", "category")})


def _rows(funcs: DataFrame, found: Column) -> DataFrame:
    names = F.array(*[F.lit(n) for n in RULE_NAMES])
    return funcs.select(
        "file_id", "relative_path", "func_id", F.col("name").alias("func_name"), F.posexplode(found).alias("pos", "x")
    ).select(
        "file_id",
        F.col("relative_path").alias("file"),
        "func_id",
        "func_name",
        "pos",
        F.get(names, F.col("x.rule")).alias("type"),
        F.col("x.rank").alias("severity_rank"),
        F.col("x.line").alias("line"),
        F.col("x.end_line").alias("end_line"),
        F.map_from_entries("x.evidence").alias("evidence"),
    ).withColumns(_RULE_KIND())


def detect(funcs: DataFrame, rule: str) -> DataFrame:
    """All findings of one rule, also several on one line."""
    return _rows(funcs, _ONE[rule]())


def detect_all(funcs: DataFrame) -> DataFrame:
    """Findings of all rules, one per rule, function and line; ``pos`` orders them by severity, rule and place in a function."""
    return _rows(funcs, _ALL())


def _described() -> dict[str, Column]:
    fields = F.map_concat(
        "evidence",
        F.create_map(
            F.lit("function"), F.col("func_name"),
            F.lit("file"), F.col("file"),
            F.lit("line_1"), (F.col("line") + 1).cast("string"),
        ),
    )
    texts = {c: render(_rule_value(c), fields) for c in ("description", "consequence", "correct_behavior")}
    return {**texts, "incorrect_assumptions": _rule_value("incorrect_assumptions")}


_DESCRIBED = once(_described)


def describe(findings: DataFrame) -> DataFrame:
    """Add the filled-in texts of the rule. Do it last: the picks before need no texts."""
    return findings.withColumns(_DESCRIBED())


_ANY_SECRET = "|".join(f"(?:{p})" for p, _ in K.SECRETS)
_NO_SECRETS = "array<struct<line:int,nth:int,secret_type:string,variable:string,preview:string>>"
# One pass tells that a text has none, as most have.
_SECRETS = once(
    lambda: F.when(F.col("content").rlike(_ANY_SECRET), secret_hits(F.col("content"))).otherwise(
        F.array().cast(_NO_SECRETS)
    )
)


def with_secrets(files: DataFrame) -> DataFrame:
    """Add the file's literal credentials, which the secret rule reports for each function."""
    return unmarked(files).withColumn("secrets", _SECRETS())


def audit(files: DataFrame) -> DataFrame:
    """``files -> functions -> findings`` with texts, in one narrow job."""
    return describe(detect_all(functions(with_secrets(files))))


def file_secrets(files: DataFrame) -> DataFrame:
    """All literal credentials of a file, whether or not it has functions."""
    return (
        unmarked(files)
        .select(
            "file_id", "relative_path", F.explode(_SECRETS()).alias("s")
        )
        .select("file_id", "relative_path", "s.line", "s.secret_type", "s.variable", "s.preview")
    )
