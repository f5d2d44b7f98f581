"""Queries on functions, findings, code paths and questions (groups F, D, P and B).

The corpus has one file per part, made from 15 templates with known facts, so the check
SQL joins the parts with the facts of their template ``k``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graspmeter.functions.text import regex_hits, split_lines
from graspmeter.operators import code_functions as fn
from graspmeter.operators import detectors, paths, questions
from graspmeter.plans import driver_tables as D
from graspmeter.question_texts import HOW_TO_FIX, WHAT_HAPPENS
from graspmeter.rule_texts import RULES

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _facts(name: str, columns: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"{name}(k, {columns}) AS (VALUES {values})"


CF = f"cf AS (SELECT *, CAST(file_id AS BIGINT) AS n FROM ({D.CODE_FILES_SQL}) y)"
JS = [k for k in range(15) if k != 12]

# k, first line, last line
SPANS = [(0, 0, 3), (1, 0, 2), (2, 0, 2), (3, 0, 6), (4, 0, 5), (5, 0, 6), (6, 0, 2), (7, 0, 2), (8, 0, 2),
         (9, 0, 5), (10, 0, 3), (11, 0, 2), (12, 0, 2), (13, 0, 2), (14, 0, 3)]
PARAMS = [(7, 0, "id"), (8, 0, "req"), (8, 1, "res"), (12, 0, "uid"), (13, 0, "user"), (14, 0, "user")]
TRIES = [(3, 1, 3, 3, 5, "e", False, False, True), (4, 1, 3, 3, 4, "e", False, False, False),
         (5, 1, 3, 3, 5, "err", False, False, False)]
RETURNS = [(0, 2, "n", "value"), (9, 2, "null", "null"), (9, 4, "n", "value"), (10, 1, "1", "value"),
           (12, 1, "r", "value"), (13, 1, "user.name", "value"), (14, 1, "null", "null"), (14, 2, "user.name", "value")]
AWAITS = [(2, 1, "db.find(1)", False)]
CALLS = [(1, 1, "stripe.refund", False, False), (2, 1, "db.find", False, True), (3, 2, "db.find", True, False),
         (4, 2, "db.find", True, False), (5, 2, "db.find", True, False), (7, 1, "db.query", False, False),
         (11, 1, "db.query", False, False), (12, 0, "db.execute", False, False)]
# k, rule, line, last line (null: none)
FINDINGS = [
    (1, "MISSING_ERROR_HANDLING", 1, None), (2, "MISSING_ERROR_HANDLING", 1, None), (2, "UNHANDLED_ASYNC", 1, None),
    (3, "SILENT_CATCH", 3, 5), (4, "ERROR_SWALLOWING", 3, 4), (5, "EXPOSED_INTERNAL_ERROR", 4, 5),
    (6, "HARDCODED_SECRET", 1, None), (7, "SQL_INJECTION_RISK", 1, None), (7, "MISSING_ERROR_HANDLING", 1, None),
    (7, "UNCHECKED_PARAMETER", 1, None), (8, "MISSING_INPUT_VALIDATION", 1, None),
    (9, "INCONSISTENT_RETURN_TYPE", 0, None), (10, "DEAD_CODE_AFTER_RETURN", 2, None), (11, "MISSING_AWAIT", 1, None),
    (11, "MISSING_ERROR_HANDLING", 1, None), (12, "MISSING_ERROR_HANDLING", 0, None),
    (12, "UNCHECKED_PARAMETER", 0, None), (13, "UNCHECKED_PARAMETER", 1, None), (14, "DEAD_CODE_AFTER_RETURN", 2, None),
    (14, "INCONSISTENT_RETURN_TYPE", 0, None),
]


def _files(spark, sf_dir):
    return D.code_files(spark, sf_dir)


def _functions(spark, sf_dir):
    return fn.functions(detectors.with_secrets(_files(spark, sf_dir)))


def _with(*facts: str) -> str:
    return "WITH " + ", ".join([CF, *facts]) + " "


# --- lines, tokens, functions ---------------------------------------------------------------


@query("f0_regex_hits", """
WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM h)
SELECT doc_id, CAST(line_no AS INT) AS line, hit FROM (
  SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[0-9]+')) AS hit FROM l) x""")
def f0_regex_hits(spark, sf_dir):
    docs = D.documents(spark, sf_dir)
    return docs.select(
        F.col("file_id").cast("bigint").alias("doc_id"), F.explode(regex_hits(F.col("content"), "[0-9]+")).alias("h")
    ).select("doc_id", F.col("h.line").alias("line"), F.col("h.text").alias("hit"))


@query("f1_explode_lines", """
WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS INT) AS line_no, unnest(lines) AS line FROM h""")
def f1_explode_lines(spark, sf_dir):
    return D.documents(spark, sf_dir).select(
        F.col("file_id").cast("bigint").alias("doc_id"), F.posexplode(split_lines(F.col("content"))).alias("line_no", "line")
    )


_CANDIDATES = [(k, 0, 0, None) for k in JS] + [(k, 2, 0, None) for k in JS]
_KEYWORDS = [(3, 2, 3, "catch"), (4, 2, 3, "catch"), (5, 2, 3, "catch"), (9, 2, 1, "if"), (14, 2, 1, "if")]
_CAND_SQL = "SELECT file_id, CAST(rule AS INT) AS rule, CAST(line AS INT) AS line, coalesce(word, concat('f_', n)) AS name FROM cf JOIN c USING (k)"


@query("f2_js_function_candidates", _with(_facts("c", "rule, line, word", _CANDIDATES + _KEYWORDS)) + _CAND_SQL)
def f2_js_function_candidates(spark, sf_dir):
    return fn.candidates(_files(spark, sf_dir), keep_keywords=True).select("file_id", "rule", "line", "name")


@query("f3_method_keyword_filter", _with(_facts("c", "rule, line, word", _CANDIDATES)).replace("NULL", "NULL::VARCHAR") + _CAND_SQL)
def f3_method_keyword_filter(spark, sf_dir):
    return fn.candidates(_files(spark, sf_dir)).select("file_id", "rule", "line", "name")


_SPAN_FACTS = _facts("f", "start_line, end_line", SPANS)


@query("f4_candidate_dedup", _with(_SPAN_FACTS) + "SELECT file_id, concat(file_id, '#', start_line) AS func_id, concat('f_', n) AS name FROM cf JOIN f USING (k)")
def f4_candidate_dedup(spark, sf_dir):
    return fn.function_spans(_files(spark, sf_dir)).select("file_id", "func_id", "name")


@query("f5_opening_brace", _with() + "SELECT file_id, CAST(instr(content, '{') - 1 AS INT) AS opening FROM cf WHERE k <> 12")
def f5_opening_brace(spark, sf_dir):
    spans = fn.function_spans(_files(spark, sf_dir)).where(F.col("language") != "python")
    return spans.select("file_id", (F.length("full_source") - F.length("body") - 2).alias("opening"))


@query("f6_brace_pairing", _with(_SPAN_FACTS) + """
SELECT file_id, CAST(end_line AS INT) AS end_line,
       substr(content, instr(content, '{') + 1, length(content) - instr(content, '{') - 1) AS body
FROM cf JOIN f USING (k) WHERE k <> 12""")
def f6_brace_pairing(spark, sf_dir):
    spans = fn.function_spans(_files(spark, sf_dir)).where(F.col("language") != "python")
    return spans.select("file_id", "end_line", "body")


@query("f7_py_functions", _with() + "SELECT file_id, concat('f_', n) AS name, 'uid' AS param_text, 0 AS start_line FROM cf WHERE k = 12")
def f7_py_functions(spark, sf_dir):
    spans = fn.function_spans(_files(spark, sf_dir).where(F.col("language") == "python"))
    return spans.select("file_id", "name", "param_text", "start_line")


@query("f8_py_body_by_indent", _with() + "SELECT file_id, 2 AS end_line, concat('    r = db.execute(uid)', chr(10), '    return r') AS body FROM cf WHERE k = 12")
def f8_py_body_by_indent(spark, sf_dir):
    spans = fn.function_spans(_files(spark, sf_dir).where(F.col("language") == "python"))
    return spans.select("file_id", "end_line", "body")


@query("f9_parameters", _with(_facts("p", "pos, name", PARAMS)) + "SELECT file_id, CAST(pos AS INT) AS pos, name, false AS has_default, false AS is_optional FROM cf JOIN p USING (k)")
def f9_parameters(spark, sf_dir):
    return fn.facts(_functions(spark, sf_dir), "parameters").select("file_id", "pos", "name", "has_default", "is_optional")


@query("f10_branch_count_func", _with() + "SELECT file_id, CASE WHEN k IN (3, 4, 5, 9, 14) THEN 1 ELSE 0 END AS branch_count FROM cf")
def f10_branch_count_func(spark, sf_dir):
    return _functions(spark, sf_dir).select("file_id", "branch_count")


@query("f11_nesting_depth_func", _with() + "SELECT file_id, CASE WHEN k IN (3, 4, 5, 9, 14) THEN 1 ELSE 0 END AS nesting_depth FROM cf")
def f11_nesting_depth_func(spark, sf_dir):
    return _functions(spark, sf_dir).select("file_id", "nesting_depth")


@query("f12_null_checked_params", _with() + "SELECT file_id, CASE WHEN k = 14 THEN 'user' ELSE '' END AS checked FROM cf")
def f12_null_checked_params(spark, sf_dir):
    return _functions(spark, sf_dir).select("file_id", F.array_join("null_checked", ",").alias("checked"))


@query("f13_try_blocks", _with(_facts("t", "try_start, try_end, catch_start, catch_end, catch_param, has_rethrow, has_return, only_logs", TRIES)) + """
SELECT file_id, CAST(try_start AS INT) AS try_start, CAST(try_end AS INT) AS try_end, CAST(catch_start AS INT) AS catch_start,
       CAST(catch_end AS INT) AS catch_end, catch_param, has_rethrow, has_return, only_logs FROM cf JOIN t USING (k)""")
def f13_try_blocks(spark, sf_dir):
    return fn.facts(_functions(spark, sf_dir), "try_blocks").select(
        "file_id", "try_start", "try_end", "catch_start", "catch_end", "catch_param", "has_rethrow", "has_return", "only_logs"
    )


@query("f14_returns", _with(_facts("r", "line, expression, kind", RETURNS)) + "SELECT file_id, CAST(line AS INT) AS line, expression, kind FROM cf JOIN r USING (k)")
def f14_returns(spark, sf_dir):
    return fn.facts(_functions(spark, sf_dir), "returns").select("file_id", "line", "expression", "kind")


# The templates throw nothing: an error line is put before the end of each file.
@query("f15_throws", _with(_SPAN_FACTS) + """
SELECT file_id, CAST(end_line AS INT) AS line, concat('new TypeError("', n, '")') AS expression, false AS in_try
FROM cf JOIN f USING (k) WHERE k <> 12""")
def f15_throws(spark, sf_dir):
    line = F.concat(F.lit('  throw new TypeError("'), "file_id", F.lit('");\n}'))
    files = _files(spark, sf_dir).where(F.col("language") != "python")
    thrown = files.withColumn("content", F.concat(F.regexp_replace("content", r"\}\z", ""), line))
    return fn.facts(fn.functions(thrown), "throws").select("file_id", "line", "expression", "in_try")


@query("f16_awaits", _with(_facts("a", "line, expression, in_try", AWAITS)) + "SELECT file_id, CAST(line AS INT) AS line, expression, in_try FROM cf JOIN a USING (k)")
def f16_awaits(spark, sf_dir):
    return fn.facts(_functions(spark, sf_dir), "awaits").select("file_id", "line", "expression", "in_try")


_CALL_FACTS = _facts("c", "line, callee, in_try, is_awaited", CALLS)


@query("f17_external_calls", _with(_CALL_FACTS) + "SELECT file_id, CAST(line AS INT) AS line, callee, concat(callee, ')') AS expression, is_awaited FROM cf JOIN c USING (k)")
def f17_external_calls(spark, sf_dir):
    return fn.facts(_functions(spark, sf_dir), "calls").select("file_id", "line", "callee", "expression", "is_awaited")


@query("f18_in_try", _with(_CALL_FACTS, _facts("t", "try_start, try_end, catch_start, catch_end, catch_param, has_rethrow, has_return, only_logs", TRIES)) + """
SELECT file_id, CAST(line AS INT) AS line, callee, coalesce(line BETWEEN try_start AND try_end, false) AS in_try
FROM cf JOIN c USING (k) LEFT JOIN t USING (k)""")
def f18_in_try(spark, sf_dir):
    return fn.facts(_functions(spark, sf_dir), "calls").select("file_id", "line", "callee", "in_try")


def _count(rows: list[tuple]) -> str:
    ks = [r[0] for r in rows]
    cases = " ".join(f"WHEN {k} THEN {ks.count(k)}" for k in sorted(set(ks)))
    return f"CASE k {cases} ELSE 0 END"


@query("f19_function_table", _with(_SPAN_FACTS) + f"""
SELECT file_id, concat('f_', n) AS name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line,
       {_count(PARAMS)} AS n_params, {_count(RETURNS)} AS n_returns, 0 AS n_throws, {_count(AWAITS)} AS n_awaits,
       {_count(CALLS)} AS n_calls, {_count(TRIES)} AS n_tries, content AS full_source
FROM cf JOIN f USING (k)""")
def f19_function_table(spark, sf_dir):
    lists = {"n_params": "parameters", "n_returns": "returns", "n_throws": "throws", "n_awaits": "awaits",
             "n_calls": "calls", "n_tries": "try_blocks"}
    return _functions(spark, sf_dir).select(
        "file_id", "name", "start_line", "end_line", *[F.size(c).alias(a) for a, c in lists.items()], "full_source"
    )


# --- detectors ------------------------------------------------------------------------------

_FINDING_FACTS = _facts("x", "type, line, end_line", FINDINGS)
_RULE_NO = "CASE type " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(RULES)) + " END"
_SEVERITY = "CASE type " + " ".join(f"WHEN '{r}' THEN '{v['severity']}'" for r, v in RULES.items()) + " END"
_CATEGORY = "CASE type " + " ".join(f"WHEN '{r}' THEN '{v['category']}'" for r, v in RULES.items()) + " END"

_DETECTOR_IDS = [
    ("d1_missing_error_handling", "MISSING_ERROR_HANDLING"),
    ("d2_silent_catch", "SILENT_CATCH"),
    ("d3_unchecked_parameter", "UNCHECKED_PARAMETER"),
    ("d4_unhandled_async", "UNHANDLED_ASYNC"),
    ("d5_inconsistent_return", "INCONSISTENT_RETURN_TYPE"),
    ("d6_hardcoded_secret", "HARDCODED_SECRET"),
    ("d7_sql_injection", "SQL_INJECTION_RISK"),
    ("d8_missing_input_validation", "MISSING_INPUT_VALIDATION"),
    ("d9_error_swallowing", "ERROR_SWALLOWING"),
    ("d10_exposed_internal_error", "EXPOSED_INTERNAL_ERROR"),
    ("d11_dead_code_after_return", "DEAD_CODE_AFTER_RETURN"),
    ("d12_missing_await", "MISSING_AWAIT"),
]
# What the evidence of a rule has to say about the template's only case.
_EVIDENCE = {
    "MISSING_ERROR_HANDLING": ("callee", "CASE k WHEN 1 THEN 'stripe.refund' WHEN 2 THEN 'db.find' WHEN 12 THEN 'db.execute' ELSE 'db.query' END"),
    "SILENT_CATCH": ("operation_in_try", "'db.find)'"),
    "UNCHECKED_PARAMETER": ("parameter", "CASE k WHEN 7 THEN 'id' WHEN 12 THEN 'uid' ELSE 'user' END"),
    "UNHANDLED_ASYNC": ("async_call", "'db.find(1)'"),
    "INCONSISTENT_RETURN_TYPE": ("types", "'null, value'"),
    "HARDCODED_SECRET": ("partial_value", "'abcd...'"),
    "SQL_INJECTION_RISK": ("variable", "'user_input'"),
    "MISSING_INPUT_VALIDATION": ("kind", "'generic'"),
    "ERROR_SWALLOWING": ("operation_in_try", "'db.find)'"),
    "EXPOSED_INTERNAL_ERROR": ("catch_line_1", "'4'"),
    "DEAD_CODE_AFTER_RETURN": ("dead_code_source", "CASE k WHEN 10 THEN 'n = 2;' ELSE 'return user.name;' END"),
    "MISSING_AWAIT": ("async_call", "'db.query'"),
}


def _add_detector(name: str, rule: str) -> None:
    key, expected = _EVIDENCE[rule]
    sql = _with(_FINDING_FACTS) + (
        "SELECT path AS file, concat('f_', n) AS func_name, type, CAST(line AS INT) AS line, CAST(end_line AS INT) AS end_line, "
        f"{expected} AS evidence FROM cf JOIN x USING (k) WHERE type = '{rule}'"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        return detectors.detect(_functions(spark, sf_dir), rule).select(
            "file", "func_name", "type", "line", "end_line", F.element_at("evidence", F.lit(key)).alias("evidence")
        )


for _name, _rule in _DETECTOR_IDS:
    _add_detector(_name, _rule)

_TITLE = "CASE type " + " ".join(
    f"WHEN '{r}' THEN " + _lit(v["consequence"]) for r, v in RULES.items()
    if "{" not in v["consequence"]
) + " END"


@query("d13_detect_all", _with(_FINDING_FACTS) + f"""
SELECT path AS file, concat('f_', n) AS func_name, type, {_SEVERITY} AS severity, {_CATEGORY} AS category,
       CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY file_id ORDER BY
         CASE {_SEVERITY} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, {_RULE_NO}, line) - 1 AS INT) AS pos,
       coalesce({_TITLE}, '') AS fixed_consequence
FROM cf JOIN x USING (k)""")
def d13_detect_all(spark, sf_dir):
    found = detectors.describe(detectors.detect_all(_functions(spark, sf_dir)))
    open_text = F.col("type").isin("MISSING_ERROR_HANDLING", "UNCHECKED_PARAMETER")
    return found.select(
        "file", "func_name", "type", "severity", "category", "line", "pos",
        F.when(open_text, "").otherwise(F.col("consequence")).alias("fixed_consequence"),
    )


_SECRET = r"(?i)(?:api[_-]?key|apikey|secret|password|passwd|pwd|token|auth)\s*[:=]\s*[''\"][A-Za-z0-9_\-\.]{8,}[''\"]"
_SECRET_RX = [_SECRET, "sk-[A-Za-z0-9]{20,}", "sk_live_[A-Za-z0-9]{20,}", "ghp_[A-Za-z0-9]{36}", "AKIA[A-Z0-9]{16}"]


@query("d6_file_secrets", """
WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM h),
s AS (""" + " UNION ".join(f"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{rx}')) AS hit FROM l" for rx in _SECRET_RX) + """)
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(line_no AS INT) AS line FROM s""")
def d6_file_secrets(spark, sf_dir):
    return detectors.file_secrets(D.documents(spark, sf_dir)).select("file_id", "line")


# --- code paths -----------------------------------------------------------------------------

# k, path, condition, actions, return value, side effects
PATHS = [
    (0, 0, "normal execution", "returns n", "n", ""),
    (1, 0, "normal execution", "calls stripe.refund (line 2)", "undefined (implicit)", ""),
    (2, 0, "normal execution", "awaits db.find (line 2)", "undefined (implicit)", ""),
    (3, 0, "normal execution", "calls db.find (line 3)", "undefined (implicit)", "logs to console"),
    (4, 0, "normal execution", "calls db.find (line 3)", "undefined (implicit)", ""),
    (5, 0, "normal execution", "calls db.find (line 3)", "undefined (implicit)", "sends HTTP response"),
    (6, 0, "normal execution", "", "undefined (implicit)", ""),
    (7, 0, "normal execution", "calls db.query (line 2)", "undefined (implicit)", "writes to database"),
    (8, 0, "normal execution", "", "undefined (implicit)", ""),
    (9, 0, "normal execution", "returns n", "n", ""),
    (10, 0, "normal execution", "returns 1", "1", ""),
    (11, 0, "normal execution", "calls db.query (line 2)", "undefined (implicit)", "writes to database"),
    (12, 0, "normal execution", "calls db.execute (line 1),returns r", "r", "writes to database"),
    (13, 0, "normal execution", "returns user.name", "user.name", ""),
    (14, 0, "normal execution", "returns user.name", "user.name", ""),
    (9, 1, "if result is null/not found", "returns null early", "null", ""),
    (14, 1, "if result is null/not found", "returns null early", "null", ""),
    (3, 2, "if db.find throws", "logs error to console", "undefined (implicit) — error is swallowed after logging", "logs to console"),
    (4, 2, "if db.find throws", "handles error silently", "undefined (implicit)", ""),
    (5, 2, "if db.find throws", "handles error silently", "undefined (implicit)", "sends HTTP response"),
] + [
    (k, 3, "if unprotected external call fails", "error propagates up the call stack", "throws unhandled exception", "")
    for k in (1, 2, 7, 11, 12)
]
_PATH_FACTS = _facts("p", "path_no, condition, actions, return_value, side_effects", PATHS)
_PATH_SQL = (
    "SELECT file_id, concat('f_', n) AS func_name, CAST(path_no AS INT) AS path_no, condition, actions, return_value, "
    "side_effects, path_no = 3 AS can_throw FROM cf JOIN p USING (k)"
)


def _path_rows(spark, sf_dir, which):
    return paths.trace_paths(_functions(spark, sf_dir), which).select(
        "file_id", "func_name", "path_no", "condition", F.array_join("actions", ",").alias("actions"), "return_value",
        F.array_join("side_effects", ",").alias("side_effects"), "can_throw",
    )


@query("p1_happy_path", _with(_PATH_FACTS) + _PATH_SQL + " WHERE path_no = 0")
def p1_happy_path(spark, sf_dir):
    return _path_rows(spark, sf_dir, "happy")


@query("p2_null_path", _with(_PATH_FACTS) + _PATH_SQL + " WHERE path_no = 1")
def p2_null_path(spark, sf_dir):
    return _path_rows(spark, sf_dir, "null")


@query("p3_error_path", _with(_PATH_FACTS) + _PATH_SQL + " WHERE path_no = 2")
def p3_error_path(spark, sf_dir):
    return _path_rows(spark, sf_dir, "error")


@query("p4_unhandled_path", _with(_PATH_FACTS) + _PATH_SQL + " WHERE path_no = 3")
def p4_unhandled_path(spark, sf_dir):
    return _path_rows(spark, sf_dir, "unhandled")


@query("p5_side_effects", _with() + r"""
SELECT file_id, concat_ws(',', CASE WHEN regexp_matches(content, 'console\.(log|error|warn)') THEN 'logs to console' END,
  CASE WHEN regexp_matches(content, 'res\.(json|send|status)') THEN 'sends HTTP response' END,
  CASE WHEN regexp_matches(content, '\.save\(\)|\.create\(|db\.query|db\.execute') THEN 'writes to database' END,
  CASE WHEN regexp_matches(content, 'sendEmail|sendMail|nodemailer') THEN 'sends email' END,
  CASE WHEN regexp_matches(content, 'redis\.set|cache\.set') THEN 'writes to cache' END) AS side_effects FROM cf""")
def p5_side_effects(spark, sf_dir):
    spans = fn.function_spans(_files(spark, sf_dir))
    return spans.select("file_id", F.array_join(paths.side_effects(F.col("body")), ",").alias("side_effects"))


@query("p6_trace_paths", _with(_PATH_FACTS) + _PATH_SQL)
def p6_trace_paths(spark, sf_dir):
    return _path_rows(spark, sf_dir, "all")


# --- question bank --------------------------------------------------------------------------

_FILE = "regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g')"
_BASE = (
    f"b AS (SELECT file_id, path, repo, n, k, type, CAST(line AS INT) AS line, CAST(end_line AS INT) AS end_line, {_SEVERITY} AS severity, "
    f"{_CATEGORY} AS category, concat(type, '-', {_FILE}, '-', line) AS id FROM cf JOIN x USING (k))"
)
_BOTH = "v(variant, suffix) AS (VALUES (0, ''), (1, '-v1'))"
_DIFF = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _template_sql(texts: dict, part: str) -> str:
    """Template text of a rule with its places filled, as SQL."""
    values = {
        "function": "concat('f_', n)", "file": "path", "line_1": "CAST(line + 1 AS VARCHAR)",
        "external_call": f"concat({_EVIDENCE['MISSING_ERROR_HANDLING'][1]}, ')')",
        "callee": _EVIDENCE["MISSING_ERROR_HANDLING"][1],
        "parameter": _EVIDENCE["UNCHECKED_PARAMETER"][1], "secret_type": "'api_key'", "partial_value": "'abcd...'",
        "variable": "'user_input'", "types": "'null, value'",
        "reason_line_1": "CAST(line AS VARCHAR)", "reason": "'return statement'", "catch_line_1": "'4'", "line_text": "'const r = db.query(1);'",
    }
    cases = []
    for rule in RULES:
        text = texts[rule].get(part)
        if text is None:
            text = {"correct": RULES[rule]["correct_behavior"]}[part]
        pieces = []
        for i, piece in enumerate(text.replace("}", "{").split("{")):
            if i % 2:
                value = values.get(piece, "'db.query'")
                if piece == "async_call":
                    value = "'db.find(1)'" if rule == "UNHANDLED_ASYNC" else "'db.query'"
                if piece == "variable" and rule == "HARDCODED_SECRET":
                    value = "'api_key'"
                pieces.append(value)
            elif piece:
                pieces.append(_lit(piece))
        cases.append(f"WHEN '{rule}' THEN concat({', '.join(pieces)})")
    return "CASE type " + " ".join(cases) + " END"


def _findings(spark, sf_dir):
    return detectors.detect_all(_functions(spark, sf_dir))


def _right(options: str = "options"):
    return F.get(F.filter(options, lambda o: o["is_correct"]), F.lit(0))["text"]


@query("b1_severity_to_difficulty", _with(_FINDING_FACTS, _BASE) + f"SELECT path AS file, type, line, {_DIFF} AS difficulty FROM b")
def b1_severity_to_difficulty(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return found.select("file", "type", "line", questions.difficulty_of(F.col("severity")).alias("difficulty"))


@query("b2_question_id", _with(_FINDING_FACTS, _BASE, _BOTH) + "SELECT concat(id, suffix) AS id, path AS file FROM b CROSS JOIN v")
def b2_question_id(spark, sf_dir):
    found = detectors.detect_all(_functions(spark, sf_dir)).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    return found.select(
        questions.question_id(F.col("type"), F.col("file"), F.col("line"), F.col("variant")).alias("id"), "file"
    )


def _bank(spark, sf_dir, variants):
    q = questions.render_questions(_findings(spark, sf_dir), variants)
    return q.select(
        "id", "question", "difficulty", "category", _right().alias("correct"),
        F.size("options").alias("n_options"),
        F.size(F.filter("options", lambda o: o["is_correct"])).alias("n_correct"),
        F.col("code_reference.start_line").alias("start_line"), F.col("code_reference.end_line").alias("end_line"),
    )


def _bank_sql(texts: dict, suffix: str) -> str:
    return _with(_FINDING_FACTS, _BASE) + (
        f"SELECT concat(id, '{suffix}') AS id, {_template_sql(texts, 'question')} AS question, {_DIFF} AS difficulty, category, "
        f"{_template_sql(texts, 'correct')} AS correct, 4 AS n_options, 1 AS n_correct, line AS start_line, "
        "coalesce(end_line, line + 5) AS end_line FROM b"
    )


@query("b3_render_templates_v0", _bank_sql(WHAT_HAPPENS, ""))
def b3_render_templates_v0(spark, sf_dir):
    return _bank(spark, sf_dir, "first")


@query("b4_render_templates_v1", _bank_sql(HOW_TO_FIX, "-v1"))
def b4_render_templates_v1(spark, sf_dir):
    return _bank(spark, sf_dir, "fix")


# Findings of all rules are given the name of a rule without templates, some lack it or the function.
@query("b5_fallback_template", _with(_FINDING_FACTS, _BASE, _BOTH) + f"""
SELECT concat('RACE_CONDITION_RISK-', {_FILE}, '-', line) AS id,
       concat('In function "f_', n, '" (', path, ':', line + 1, '): ', {_template_sql(RULES, 'description')}, ' What is the impact of this issue?') AS question,
       '' AS missing_field
FROM b CROSS JOIN v WHERE n % 5 <> 0 AND n % 7 <> 0
UNION ALL SELECT '', '', CASE WHEN n % 7 = 0 THEN 'type' ELSE 'func_name' END FROM b WHERE n % 5 = 0 OR n % 7 = 0""")
def b5_fallback_template(spark, sf_dir):
    n = F.col("file_id").cast("bigint")
    odd = detectors.describe(_findings(spark, sf_dir)).withColumns(
        {
            "type": F.when(n % 7 == 0, "").otherwise("RACE_CONDITION_RISK"),
            "func_name": F.when(n % 5 == 0, "").otherwise(F.col("func_name")),
        }
    )
    good = questions.render_questions(odd).select("id", "question", F.lit("").alias("missing_field"))
    bad = questions.rejected_findings(odd).select(F.lit("").alias("id"), F.lit("").alias("question"), "missing_field")
    return good.unionByName(bad)


@query("b6_shuffle_options", _with(_FINDING_FACTS, _BASE, _BOTH) + "SELECT concat(id, suffix) AS id, 'ABCD' AS labels, 4 AS n_texts, 1 AS n_correct FROM b CROSS JOIN v")
def b6_shuffle_options(spark, sf_dir):
    q = questions.render_questions(_findings(spark, sf_dir), seed=7)
    return q.select(
        "id",
        F.array_join(F.transform("options", lambda o: o["label"]), "").alias("labels"),
        F.size(F.array_distinct(F.transform("options", lambda o: o["text"]))).alias("n_texts"),
        F.size(F.filter("options", lambda o: o["is_correct"])).alias("n_correct"),
    )


@query("b7_focus_filters", _with(_FINDING_FACTS, _BASE) + "SELECT path AS file, type, line FROM b WHERE category = 'error-handling' AND contains(path, '/api/')")
def b7_focus_filters(spark, sf_dir):
    files = _files(spark, sf_dir).where(F.col("path").contains("/api/")).select(F.col("path").alias("file"))
    return questions.focus(_findings(spark, sf_dir), files, "error-handling").select("file", "type", "line")


@query("b8_difficulty_filter", _with(_FINDING_FACTS, _BASE) + """
SELECT 2 AS difficulty, path AS file, type FROM b WHERE severity IN ('low', 'medium')
UNION ALL SELECT 3, path, type FROM b WHERE severity IN ('medium', 'high')
UNION ALL SELECT 5, path, type FROM b WHERE severity IN ('high', 'critical')""")
def b8_difficulty_filter(spark, sf_dir):
    found = _findings(spark, sf_dir)
    level = F.explode(
        F.array(*[
            F.struct(F.lit(d).alias("difficulty"), F.array(*[F.lit(s) for s in questions.severities_for(d)]).alias("allowed"))
            for d in (2, 3, 5)
        ])
    )
    rows = found.select("file", "type", "severity", level.alias("l"))
    return rows.where(F.array_contains("l.allowed", F.col("severity"))).select(
        F.col("l.difficulty").alias("difficulty"), "file", "type"
    )


# All files of a brand are taken as one file here, so that names and rules repeat in it.
@query("b9_finding_dedup", _with(_FINDING_FACTS, _BASE) + """
SELECT concat('dir_', n % 10) AS file, 'f' AS func_name, type, count(*) > 0 AS kept FROM b GROUP BY n % 10, type""")
def b9_finding_dedup(spark, sf_dir):
    found = _findings(spark, sf_dir).withColumns(
        {"file": F.concat(F.lit("dir_"), (F.col("file_id").cast("bigint") % 10).cast("string")), "func_name": F.lit("f")}
    )
    return questions.first_per_rule(found).select("file", "func_name", "type", F.lit(True).alias("kept"))


_ORDER = (
    "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, path, pos, variant"
)
_NUMBERED = (
    "o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 "
    f"WHEN 'medium' THEN 2 ELSE 3 END, {_RULE_NO}, line) AS pos FROM b)"
)


_SHOWN_RULES = ["SQL_INJECTION_RISK", "HARDCODED_SECRET", "MISSING_ERROR_HANDLING"]


def _shown(spark, sf_dir):
    """Shown already: the first variant of three rules in the files of some repositories."""
    rules = F.explode(F.array(*[F.lit(r) for r in _SHOWN_RULES])).alias("type")
    files = _files(spark, sf_dir).where(F.col("repo").endswith("2")).select(F.col("path").alias("file"), rules)
    lines = files.select("file", "type", F.explode(F.array(F.lit(0), F.lit(1))).alias("line"))
    return lines.select(
        questions.question_id(F.col("type"), F.col("file"), F.col("line"), F.lit(0)).alias("question_id")
    )


_NOT_SHOWN = f"NOT (repo LIKE '%2' AND variant = 0 AND type IN ({', '.join(_lit(r) for r in _SHOWN_RULES)}))"


@query("b10_fresh_pool", _with(_FINDING_FACTS, _BASE, _BOTH, _NUMBERED) + f"""
SELECT concat(id, suffix) AS id, severity FROM o CROSS JOIN v
WHERE {_NOT_SHOWN} ORDER BY {_ORDER} LIMIT 25""")
def b10_fresh_pool(spark, sf_dir):
    keys = questions.question_keys(_findings(spark, sf_dir))
    return questions.fresh_pool(keys, _shown(spark, sf_dir), 25, questions.pick_order()).select("id", "severity")


@query("b11_count_available", _with(_FINDING_FACTS, _BASE) + """
SELECT 'total' AS dimension, 'total' AS value, count(*) AS n FROM b
UNION ALL SELECT 'category', category, count(*) FROM b GROUP BY category
UNION ALL SELECT 'severity', severity, count(*) FROM b GROUP BY severity""")
def b11_count_available(spark, sf_dir):
    return questions.count_available(_findings(spark, sf_dir))


def _priorities(spark, sf_dir):
    """Every file of the corpus as a candidate with a risk and, for some, a score."""
    files = _files(spark, sf_dir).select(
        F.col("path").alias("file"),
        F.when(F.col("language") == "python", "database").otherwise("auth").alias("category"),
        (1 + F.col("file_id").cast("bigint") % 10).cast("int").alias("risk_level"),
        F.col("file_id").cast("bigint").alias("n"),
        "repo",
    )
    scores = files.where("repo <> 'Brand#17'").select("file", (F.col("n") % 101).cast("int").alias("score"))
    return files.drop("n", "repo"), scores


_PRIORITY = "(1 + n % 10) * (1 - CASE WHEN repo <> 'Brand#17' THEN n % 101 ELSE 100 END / 100::DOUBLE)"


@query("b12_prioritize_files", _with() + f"SELECT path AS file, CAST(1 + n % 10 AS INT) AS risk_level, round({_PRIORITY}, 6) AS priority FROM cf WHERE contains(path, 'api')")
def b12_prioritize_files(spark, sf_dir):
    critical, scores = _priorities(spark, sf_dir)
    return questions.prioritize(critical, scores, focus_area="api").orderBy(F.desc("priority"), "file").select(
        "file", "risk_level", F.round("priority", 6).alias("priority")
    )


@query("b13_session_questions", _with(_FINDING_FACTS, _BASE, _BOTH, _NUMBERED) + f"""
SELECT concat(id, suffix) AS id, severity FROM o CROSS JOIN v
WHERE k = 12 AND severity IN ('medium', 'high') AND {_NOT_SHOWN}
ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, round({_PRIORITY}, 6) DESC, path, pos, variant LIMIT 10""")
def b13_session_questions(spark, sf_dir):
    critical, scores = _priorities(spark, sf_dir)
    candidates = questions.prioritize(critical, scores, focus_area="database").withColumn(
        "priority", F.round("priority", 6)
    )
    picked = questions.session_questions(
        _findings(spark, sf_dir), candidates, _shown(spark, sf_dir), n=10, difficulty=3
    )
    return picked.select("id", "severity")


@query("b14_local_questions", _with(_FINDING_FACTS, _BASE, _BOTH, _NUMBERED) + f"""
SELECT concat(id, suffix) AS id, severity, category FROM o CROSS JOIN v
WHERE severity IN ('high', 'critical') AND category = 'error-handling' ORDER BY {_ORDER} LIMIT 40""")
def b14_local_questions(spark, sf_dir):
    return questions.local_questions(
        _findings(spark, sf_dir), 40, difficulty=4, category="error-handling"
    ).select("id", "severity", "category")
