"""The driver's tables read as the domain tables of this library.

Each mapping exists twice: as a DataFrame for the jobs and as a SQL text (a CTE body) for
the check queries. The SQL is plain ANSI so that another engine can run it on the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files that a task parses; a row of a few bytes is one, so a small table can hold hours of work.
FILES_A_TASK = 2_000


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` in as many partitions as the caller names in ``graspmeter.input.partitions``.

    Without that setting in partitions of about ``rows`` rows, so that tasks do not grow with the
    table. Where no ``rows`` are given, or the table has no more than that, the files' own splits
    are used and nothing is shuffled.
    """
    wanted = int(df.sparkSession.conf.get("graspmeter.input.partitions", None) or (-(-df.count() // rows) if rows else 1))
    return df.repartition(wanted, key) if wanted > 1 else df


# --- source corpus: one generated file per part -----------------------------------------

_SOURCES = {
    0: ["export function f_N() {", "  const n = 1;", "  return n;", "}"],
    1: ["function f_N() {", "  stripe.refund(1);", "}"],
    2: ["async function f_N() {", "  await db.find(1);", "}"],
    3: ["function f_N() {", "  try {", "    db.find(1);", "  } catch (e) {",
        "    console.error(e);", "  }", "}"],
    4: ["function f_N() {", "  try {", "    db.find(1);", "  } catch (e) {", "  }", "}"],
    5: ["function f_N() {", "  try {", "    db.find(1);", "  } catch (err) {",
        "    res.json(err.message);", "  }", "}"],
    6: ["function f_N() {", '  const api_key = "abcd1234efgh";', "}"],
    7: ["function f_N(id) {", '  db.query("select " + id);', "}"],
    8: ["function f_N(req, res) {", "  const n = req.body;", "}"],
    9: ["function f_N() {", "  if (n) {", "    return null;", "  }", "  return n;", "}"],
    10: ["function f_N() {", "  return 1;", "  n = 2;", "}"],
    11: ["async function f_N() {", "  const r = db.query(1);", "}"],
    12: ["def f_N(uid):", "    r = db.execute(uid)", "    return r"],
    13: ["function f_N(user) {", "  return user.name;", "}"],
    14: ["function f_N(user) {", "  if (!user) { return null; }", "  return user.name;", "}"],
}


def _content_sql() -> str:
    cases = []
    for k, lines in _SOURCES.items():
        parts = []
        for i, line in enumerate(lines):
            if i:
                parts.append("chr(10)")
            for j, text in enumerate(line.split("N")):
                if j:
                    parts.append("CAST(p_partkey AS VARCHAR(20))")
                if text:
                    parts.append("'" + text + "'")
        cases.append(f"WHEN {k} THEN concat({', '.join(parts)})")
    return "CASE p_partkey % 15 " + " ".join(cases) + " END"


_CODE_COLUMNS = {
    "file_id": "CAST(p_partkey AS VARCHAR(20))",
    "path": (
        "concat('src/', CASE WHEN p_partkey % 4 = 0 THEN 'api' ELSE 'core' END, '/f_', "
        "CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 15 = 12 THEN '.py' ELSE '.js' END)"
    ),
    "language": "CASE WHEN p_partkey % 15 = 12 THEN 'python' ELSE 'javascript' END",
    "repo": "p_brand",
    "k": "p_partkey % 15",
    "content": _content_sql(),
}
CODE_FILES_SQL = (
    "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _CODE_COLUMNS.items()) + " FROM part"
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, relative_path, language, repo, content."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return spread(part, "p_partkey", FILES_A_TASK).selectExpr(
        *[f"{_CODE_COLUMNS[c]} AS {c}" for c in ("file_id", "path", "language", "repo", "content")],
        f"{_CODE_COLUMNS['path']} AS relative_path",
    )


# --- modules: import lines and classes, one file per part -------------------------------

_MODULE_COLUMNS = {
    "file_id": "CAST(p_partkey AS VARCHAR(20))",
    "path": (
        "concat('/ws/', replace(p_brand, '#', ''), CASE p_partkey % 7 WHEN 0 THEN '/node_modules/' "
        "WHEN 1 THEN '/.cache/' WHEN 2 THEN '/lib/api/' ELSE '/src/' END, 'm_', "
        "CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' "
        "WHEN 2 THEN '.js' WHEN 3 THEN '.jsx' WHEN 4 THEN '.py' ELSE '.md' END)"
    ),
    "relative_path": (
        "concat('src/d', CAST(p_size % 5 AS VARCHAR(20)), '/m_', CAST(p_partkey AS VARCHAR(20)), '.ts')"
    ),
    "repo": "p_brand",
    "language": "CASE WHEN p_partkey % 6 = 4 THEN 'python' ELSE 'typescript' END",
    "content": (
        "concat('import { a } from \"./m_', CAST(p_size AS VARCHAR(20)), '\";', chr(10), "
        "'import * as b from \"../d1/m_', CAST(p_partkey % 11 AS VARCHAR(20)), '\";', chr(10), "
        "'import r from \"react\";', chr(10), 'const c = require(\"./lost\");', chr(10), "
        "'export class C_', CAST(p_partkey AS VARCHAR(20)), ' {', chr(10), '  run() {}', chr(10), '}', "
        "chr(10), 'import { z } from \"./m_', CAST(p_size AS VARCHAR(20)), '\";', chr(10), "
        "'class D {}', chr(10), 'export const go = async (x) => { return x; };', chr(10), "
        "'async function f(a) { if (a) { return a ? 1 : 2; } }')"
    ),
}
MODULE_FILES_SQL = (
    "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _MODULE_COLUMNS.items()) + ", p_partkey AS n, p_size FROM part"
)


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with imports and classes; ``path`` also meets skipped folders and other extensions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return part.selectExpr(*[f"{e} AS {c}" for c, e in _MODULE_COLUMNS.items()])


# --- answers, sessions, questions, risky files --------------------------------------------

QUESTIONS_SQL = """
SELECT p_partkey AS question_id, p_brand AS file, p_type AS category,
       CAST(1 + p_size % 5 AS INT) AS difficulty, p_size AS start_line, p_size + 5 AS end_line,
       p_name AS question, concat('see ', p_name) AS explanation, CAST(p_size % 4 AS INT) AS right_no
FROM part"""

# Texts of the options; a wrong belief each, so that every rule of the grader is met.
OPTION_TEXTS = [
    "Express will catch it", "The TypeScript type system is enough", "It retries", "A global error handler",
    "It returns null", "The .gitignore", "Nothing happens", "It stops",
]

ANSWERS_SQL = """
SELECT l_orderkey AS session_id, l_linenumber AS pos, l_partkey AS question_id,
       l_suppkey AS tie_1, l_extendedprice AS tie_2,
       l_quantity <= 2 * CAST(substr(p_brand, 7) AS INT) AS is_correct, l_shipdate AS ts,
       CASE WHEN l_quantity = 50 THEN 'E'
            WHEN l_quantity <= 2 * CAST(substr(p_brand, 7) AS INT) THEN chr(CAST(65 + p_size % 4 AS INT))
            ELSE chr(CAST(65 + (p_size + 1) % 4 AS INT)) END AS selected_label
FROM lineitem JOIN part ON l_partkey = p_partkey"""

SESSIONS_SQL = """
SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate AS start_ts,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS end_ts
FROM orders"""

# The last file is risky, and no question names it, so it has no score.
CRITICAL_SQL = """
SELECT DISTINCT p_brand AS file, concat('/ws/', p_brand) AS abs_file,
       CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'payments' ELSE 'database' END AS category,
       CAST(least(10, 1 + CAST(substr(p_brand, 7) AS INT) % 10) AS INT) AS risk_level
FROM part
WHERE CAST(substr(p_brand, 7) AS INT) % 8 <> 0
UNION ALL SELECT 'Brand#00', '/ws/Brand#00', 'auth', 10"""

# Order of the answers of one session; unique together with the session.
ANSWER_ORDER = ["pos", "question_id", "tie_1", "tie_2"]


def _sql(spark: SparkSession, sf_dir: str, sql: str, *names: str, **given: DataFrame) -> DataFrame:
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **{n: given[n] if n in given else table(spark, sf_dir, n) for n in names})


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, QUESTIONS_SQL, "part")


def questions_with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in OPTION_TEXTS])
    options = F.transform(
        F.array(*[F.lit(i) for i in range(4)]),
        lambda i: F.struct(
            F.chr(65 + i).alias("label"),
            F.concat(F.get(texts, ((F.col("question_id") + i) % 8).cast("int")), F.lit(" "), F.col("question")).alias("text"),
            (i == F.col("right_no")).alias("is_correct"),
        ),
    )
    return questions(spark, sf_dir).withColumn("options", options)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return _sql(spark, sf_dir, ANSWERS_SQL, "lineitem", "part", lineitem=lineitem)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return _sql(spark, sf_dir, SESSIONS_SQL, "orders", orders=orders)


def critical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (relative), abs_file, category, risk_level; some files are missing on purpose."""
    return _sql(spark, sf_dir, CRITICAL_SQL, "part")


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of answers."""
    from graspmeter.streaming.answers import answer_stream

    schema = table(spark, sf_dir, "events").schema
    raw = answer_stream(spark, sf_dir, schema, "events.parquet")
    return raw.select(
        F.col("event_id").alias("answer_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("is_correct"),
    )


def event_periods(spark: SparkSession, sf_dir: str, periods: int, late: int = 0) -> DataFrame:
    """Events as a stream of several files in time order, a micro-batch each.

    Each file is written by its own job, as a file source takes them by the time they were
    written. With ``late`` a last file brings the oldest events once more under new ids.
    """
    from graspmeter.session import work_dir
    from graspmeter.streaming.answers import answer_stream

    events, folder = table(spark, sf_dir, "events"), work_dir(spark, "periods")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.agg(F.percentile_approx(us, [i / periods for i in range(1, periods)])).first()[0] or []
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        part = events if low is None else events.where(us >= low)
        (part if high is None else part.where(us < high)).coalesce(1).write.parquet(f"{folder}/part={i}")
    if late:
        oldest = events.orderBy("ts", "event_id").limit(late).withColumn("event_id", F.col("event_id") + 1_000_000_000)
        oldest.coalesce(1).write.parquet(f"{folder}/part={periods}")
    raw = answer_stream(spark, f"{folder}/part=*", events.schema, files_per_trigger=1)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def period_answers(spark: SparkSession, sf_dir: str, periods: int, late: int = 0) -> DataFrame:
    """Those events as answers."""
    return event_periods(spark, sf_dir, periods, late).select(
        F.col("event_id").alias("answer_id"), "user_id", "ts", (F.col("event_type") != "error").alias("is_correct")
    )


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as files: text content under a path made from source and id; ``more`` columns stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", *more)
    return spread(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".ts")).alias("path"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".ts")).alias("relative_path"),
        F.lit("typescript").alias("language"),
        F.col("source").alias("repo"),
        F.col("text").alias("content"),
        *more,
    )


DOCUMENTS_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS file_id, concat(source, '/', doc_id, '.ts') AS path,
       'typescript' AS language, source AS repo, text AS content
FROM documents"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files; the inline scripts in them give brackets to count."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select(
        F.col("page_id").cast("string").alias("file_id"),
        F.concat(F.lit("pages/"), "page_id", F.lit(".js")).alias("path"),
        F.concat(F.lit("pages/"), "page_id", F.lit(".js")).alias("relative_path"),
        F.lit("javascript").alias("language"),
        F.col("html").alias("content"),
    )


PAGES_SQL = """
SELECT CAST(page_id AS VARCHAR) AS file_id, concat('pages/', page_id, '.js') AS path,
       'javascript' AS language, html AS content
FROM pages"""
