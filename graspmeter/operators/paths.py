"""Code paths of a function: what happens normally, on null, on error, and unprotected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import let, once

_TEXTS = "array<string>"


def _listed(*items: Column) -> Column:
    """The given texts without the missing ones."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def side_effects(body: Column) -> Column:
    return _listed(*[F.when(body.rlike(rx), F.lit(label)) for rx, label in K.SIDE_EFFECTS])


def _first_return(*kinds: str) -> Column:
    return F.get(F.filter("returns", lambda r: r["kind"].isin(*kinds)), F.lit(0))


def _or(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def _path(no, condition, actions, value, effects, can_throw, throws_what) -> Column:
    return F.struct(
        F.lit(no).alias("path_no"),
        condition.alias("condition"),
        actions.cast(_TEXTS).alias("actions"),
        value.alias("return_value"),
        effects.cast(_TEXTS).alias("side_effects"),
        can_throw.alias("can_throw"),
        throws_what.cast("string").alias("throws_what"),
    )


def _happy_path() -> Column:
    steps = F.transform(
        "calls",
        lambda c: F.concat(
            F.when(c["is_awaited"], "awaits ").otherwise("calls "),
            c["callee"],
            F.lit(" (line "),
            (c["line"] + 1).cast("string"),
            F.lit(")"),
        ),
    )
    result = _first_return("value", "promise")
    last = _listed(
        F.when(result.isNotNull(), F.concat(F.lit("returns "), _or(result["expression"], "value")))
    )
    value, promise, void = _first_return("value"), _first_return("promise"), _first_return("void")
    returned = (
        F.when(value.isNotNull(), _or(value["expression"], "value"))
        .when(promise.isNotNull(), _or(promise["expression"], "Promise"))
        .when(void.isNotNull(), "void")
        .otherwise("undefined (implicit)")
    )
    uncaught = F.get(F.filter("throws", lambda t: ~t["in_try"]), F.lit(0))

    def error_class(expr: Column) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(expr, r"new\s+(\w+Error|\w+Exception)", 1), F.lit("")),
            F.nullif(F.regexp_extract(expr, r"\A(\w+)\z", 1), F.lit("")),
            F.lit("Error"),
        )

    return _path(
        0,
        F.lit("normal execution"),
        F.concat(steps, last),
        returned,
        side_effects(F.col("body")),
        uncaught.isNotNull(),
        F.when(uncaught.isNotNull(), error_class(uncaught["expression"])),
    )


def _null_path() -> Column:
    kind = _first_return("null", "undefined")["kind"]
    return F.when(
        kind.isNotNull(),
        _path(
            1,
            F.lit("if result is null/not found"),
            F.array(F.concat(F.lit("returns "), kind, F.lit(" early"))),
            kind,
            F.array(),
            F.lit(False),
            F.lit(None),
        ),
    )


def _error_path() -> Column:
    def build(b: Column) -> Column:
        inside = F.filter(
            "calls", lambda c: c["in_try"] & c["line"].between(b["try_start"], b["try_end"])
        )
        call = F.get(inside, F.lit(0))["callee"]
        logs = F.lit("logs error to console")
        actions = F.when(b["only_logs"], F.array(logs)).otherwise(
            _listed(
                F.when(b["catch_body"].rlike(K.LOG_CALL), logs),
                F.when(b["has_rethrow"], F.lit("re-throws caught error")),
                F.when(b["has_return"] & ~b["has_rethrow"], F.lit("returns fallback value")),
            )
        )
        value = (
            F.when(b["has_rethrow"], "throws (re-throws caught error)")
            .when(b["has_return"], "error response or fallback value")
            .when(b["only_logs"], "undefined (implicit) — error is swallowed after logging")
            .otherwise("undefined (implicit)")
        )
        return F.when(
            b.isNotNull(),
            _path(
                2,
                F.when(call.isNotNull(), F.concat(F.lit("if "), call, F.lit(" throws"))).otherwise(
                    "if try block throws"
                ),
                F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("handles error silently"))),
                value,
                side_effects(b["catch_body"]),
                b["has_rethrow"],
                F.when(b["has_rethrow"], "caught error (re-thrown)"),
            ),
        )

    return let(F.get("try_blocks", F.lit(0)), build)


def _unhandled_path() -> Column:
    return F.when(
        F.exists("calls", lambda c: ~c["in_try"]),
        _path(
            3,
            F.lit("if unprotected external call fails"),
            F.array(F.lit("error propagates up the call stack")),
            F.lit("throws unhandled exception"),
            F.array(),
            F.lit(True),
            F.lit("unhandled exception"),
        ),
    )


_PATHS = {
    "happy": once(lambda: F.array(_happy_path())),
    "null": once(lambda: F.array(_null_path())),
    "error": once(lambda: F.array(_error_path())),
    "unhandled": once(lambda: F.array(_unhandled_path())),
    "all": once(lambda: F.array(_happy_path(), _null_path(), _error_path(), _unhandled_path())),
}


def trace_paths(funcs: DataFrame, which: str = "all") -> DataFrame:
    """Paths per function in fixed order, at most four; ``which`` picks one kind."""
    kept = F.slice(F.filter(_PATHS[which](), lambda p: p.isNotNull()), 1, K.MAX_PATHS)
    return funcs.select(
        "file_id", "func_id", F.col("name").alias("func_name"), F.explode(kept).alias("p")
    ).select("file_id", "func_id", "func_name", "p.*")
