"""Queries on jobs that spread one long file, one hot key or very many users."""

from __future__ import annotations

from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.scores import n_right, percent
from graspmeter.operators import code_functions as fn
from graspmeter.operators import graph, metrics, report, scoring
from graspmeter.operators.lexing import brace_pairs, function_extents
from graspmeter.operators.pools import fresh_pools
from graspmeter.operators.py_blocks import nested_blocks
from graspmeter.operators.ranges import asof_join, covered, interval_join
from graspmeter.plans import catalog_code as code
from graspmeter.plans import catalog_scores as scores
from graspmeter.plans import driver_tables as D
from graspmeter.session import materialize, work_dir
from graspmeter.sources import corpus

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- braces of long files --------------------------------------------------------------------

# Documents hold no code: five letters stand for braces, quotes and the backslash.
_LETTERS, _SIGNS = "bfvgw", "{}\"'\\"
_QUOTED = r""""(?:[^"\\]|\\+"|\\+[^"\\])*"|''(?:[^''\\]|\\+''|\\+[^''\\])*''"""


@query("f6_blocks", f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, regexp_extract_all(translate(text, '{_LETTERS}', '{{}}"''\\'),
             '[^{{}}"'']+|[{{}}]|{_QUOTED}|["''](?s:.)*') AS tokens FROM documents),
x AS (SELECT file_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS no FROM t),
p AS (SELECT *, sum(length(token)) OVER u - 1 AS place, sum(CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER u AS depth
      FROM x WINDOW u AS (PARTITION BY file_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
b AS (SELECT file_id, token, place, CASE WHEN token = '}}' THEN depth + 1 ELSE depth END AS level FROM p WHERE token IN ('{{', '}}')),
n AS (SELECT *, lead(place) OVER (PARTITION BY file_id, level ORDER BY place) AS close_at FROM b)
SELECT file_id, CAST(place AS INT) AS open_at, CAST(close_at AS INT) AS close_at, CAST(level AS INT) AS level
FROM n WHERE token = '{{' AND close_at IS NOT NULL""")
def f6_blocks(spark, sf_dir):
    """All pairs of braces; blocks of 256 characters, so that every document has several."""
    files = D.documents(spark, sf_dir).withColumn("content", F.translate("content", _LETTERS, _SIGNS))
    return brace_pairs(files, 256, 8).select("file_id", "open_at", "close_at", "level")


@query("f5_function_extents", code.ORACLES["f6_brace_pairing"].replace("SELECT file_id,", "SELECT file_id, concat('f_', n) AS name,"))
def f5_function_extents(spark, sf_dir):
    files = D.code_files(spark, sf_dir)
    found = function_extents(files, 16, 4).join(files.select("file_id", "content"), "file_id")
    return found.select("file_id", "name", "end_line", F.expr("substring(content, open_at + 2, close_at - open_at - 1)").alias("body"))


# --- joins on order --------------------------------------------------------------------------


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("x1_interval_join", """
WITH iv AS (SELECT o_custkey AS k, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 90) AS b FROM orders),
pt AS (SELECT o_custkey AS k, l_shipdate AS t, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) AS n_items, sum(quantity) AS quantity FROM iv JOIN pt USING (k) WHERE t BETWEEN a AND b GROUP BY o_orderkey""")
def x1_interval_join(spark, sf_dir):
    """Orders of a customer with what was shipped to that customer while they were open."""
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), _us("o_orderdate").alias("a"))
    day = 86_400_000_000
    spans = orders.withColumn("b", F.col("a") + F.col("o_orderkey") % 90 * day)
    items = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", _us("l_shipdate").alias("at"))
    points = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select("k", "at", "l_quantity")
    met = interval_join(points, spans, ["k"], "at", "a", "b", width=day)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("quantity"))


@query("x2_asof_join", """
WITH l AS (SELECT * FROM events WHERE event_type = 'error'), r AS (SELECT user_id, ts FROM events WHERE event_type <> 'error')
SELECT event_id, l.user_id, epoch_us(r.ts) AS earlier_us FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def x2_asof_join(spark, sf_dir):
    """For each error the user's last event before it that was none."""
    events = D.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _us("ts").alias("us"))
    errors = events.where("event_type = 'error'").drop("event_type")
    found = asof_join(errors, events.where("event_type <> 'error'").select("user_id", "us"), ["user_id"], "us", "us")
    return found.select("event_id", "user_id", F.col("found.us").alias("earlier_us"))


@query("f18_in_try_tables", code.ORACLES["f18_in_try"])
def f18_in_try_tables(spark, sf_dir):
    """Calls and try blocks as separate tables, related by function and lines."""
    # Both tables come from one parse, and dealing out by ranges reads its input twice.
    functions = materialize(fn.functions(D.code_files(spark, sf_dir)).select("file_id", "func_id", "calls", "try_blocks"), "facts")
    calls = fn.facts(functions, "calls").select("file_id", "func_id", "line", "callee")
    tries = fn.facts(functions, "try_blocks").select("func_id", "try_start", "try_end")
    return covered(calls, tries, ["func_id"], "line", "try_start", "try_end", "in_try").drop("func_id")


# --- pools of very many users ----------------------------------------------------------------


@query("b10_fresh_pools", """
WITH q AS (SELECT p_brand AS question_id, row_number() OVER (ORDER BY p_brand DESC) AS rank FROM (SELECT DISTINCT p_brand FROM part) d),
u AS (SELECT DISTINCT o_custkey AS user_id FROM orders),
s AS (SELECT DISTINCT o_custkey AS user_id, p_brand AS question_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
p AS (SELECT u.user_id, q.question_id, rank, s.question_id IS NULL AS fresh FROM u CROSS JOIN q LEFT JOIN s ON s.user_id = u.user_id AND s.question_id = q.question_id),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, fresh ORDER BY rank) AS nth, bool_or(fresh) OVER (PARTITION BY user_id) AS any_fresh FROM p)
SELECT user_id, question_id, rank, fresh FROM n WHERE nth <= 5 AND fresh = any_fresh""")
def b10_fresh_pools(spark, sf_dir):
    """The next five brands for each customer, who has been shown those of earlier orders."""
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    part = D.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("question_id"))
    items = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    shown = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    questions = part.select("question_id").distinct()
    return fresh_pools(questions, shown.select("user_id", "question_id"), orders, 5, [F.desc("question_id")])


# --- resolved import graph -------------------------------------------------------------------

_EDGES = f"""
mf AS ({D.MODULE_FILES_SQL}),
x AS (SELECT relative_path AS src, concat('./m_', p_size) AS target, concat('src/d', p_size % 5, '/m_', p_size, '.ts') AS path FROM mf
      UNION ALL SELECT relative_path, concat('../d1/m_', n % 11), concat('src/d1/m_', n % 11, '.ts') FROM mf),
e AS (SELECT DISTINCT src, target, f.relative_path AS file FROM x LEFT JOIN mf f ON f.relative_path = x.path)"""


def _imports(spark, sf_dir):
    return graph.resolved_imports(D.module_files(spark, sf_dir).withColumn("repo", F.lit("ws")))


@query("c12_resolved_imports", f"WITH {_EDGES} SELECT src, target, file FROM e")
def c12_resolved_imports(spark, sf_dir):
    return _imports(spark, sf_dir).drop("repo")


@query("c12_unresolved", f"WITH {_EDGES} SELECT src, target FROM e WHERE file IS NULL")
def c12_unresolved(spark, sf_dir):
    return graph.unresolved(_imports(spark, sf_dir)).drop("repo")


@query("c12_called_by", f"WITH {_EDGES} SELECT DISTINCT file, src AS called_by FROM e WHERE file <> src")
def c12_called_by(spark, sf_dir):
    return graph.importers(_imports(spark, sf_dir)).drop("repo")


@query("c12_dependents", f"""WITH RECURSIVE {_EDGES},
r(file, dependent) AS (SELECT file, src FROM e WHERE file IS NOT NULL UNION SELECT r.file, e.src FROM r JOIN e ON e.file = r.dependent)
SELECT r.file, count(DISTINCT d.src) FILTER (WHERE d.src <> r.file) AS imported_by, count(DISTINCT dependent) FILTER (WHERE dependent <> r.file) AS n_dependents,
       bool_or(dependent = r.file) AS in_cycle
FROM r LEFT JOIN (SELECT DISTINCT file, src FROM e) d ON d.file = r.file AND d.src = r.dependent GROUP BY r.file""")
def c12_dependents(spark, sf_dir):
    return graph.dependent_counts(_imports(spark, sf_dir)).drop("repo")


# --- learning paths of all users -------------------------------------------------------------


@query("r8_learning_paths", f"""WITH {scores.FACTS}, {scores.C}, {scores.S},
u AS (SELECT DISTINCT user_id FROM s),
us AS (SELECT user_id, file, {scores._pct(scores.RIGHT, 'count(*)')} AS score FROM f JOIN s USING (session_id) GROUP BY user_id, file),
j AS (SELECT a.*, q.start_line, q.file, q.category, q.question, s.user_id, s.start_ts, {scores._OK.replace("selected_label", "a.selected_label").replace("right_no", "q.right_no")} AS ok
      FROM a JOIN q USING (question_id) JOIN s USING (session_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id, file, start_line ORDER BY start_ts DESC, session_id DESC, pos, question_id, tie_1, tie_2) AS nth FROM j WHERE NOT ok),
w1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ts DESC, session_id DESC, pos, question_id, tie_1, tie_2) AS rank FROM w WHERE nth = 1),
z AS (SELECT u.user_id, c.file, c.category, c.risk_level * (1 - coalesce(us.score, 0) / 100::DOUBLE) AS danger
      FROM u CROSS JOIN c LEFT JOIN us ON us.user_id = u.user_id AND us.file = c.file WHERE c.risk_level >= 7 AND coalesce(us.score, 0) <= 40),
i AS (SELECT user_id, 0 AS branch, rank, file, start_line, concat(replace(category, '-', ' '), ' — ', left(question, 60), '…') AS concept FROM w1 WHERE rank <= {K.LEARNING_ITEMS}
      UNION ALL SELECT user_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY danger DESC, file), file, 0, category FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY branch, rank) AS priority FROM i)
SELECT user_id, CAST(priority AS INT) AS priority, file, CAST(start_line AS INT) AS start_line, concept FROM n WHERE priority <= {K.LEARNING_ITEMS}""")
def r8_learning_paths(spark, sf_dir):
    sessions = D.sessions(spark, sf_dir).select("session_id", "user_id")
    wrong = scores._wrong_answers(spark, sf_dir).join(sessions, "session_id")
    order = [F.unix_micros(F.col("start_ts").cast("timestamp")) * -1, -F.col("session_id"), *[F.col(c) for c in D.ANSWER_ORDER]]
    facts = scoring.answer_facts(D.answers(spark, sf_dir), D.questions(spark, sf_dir)).join(sessions, "session_id")
    own = facts.groupBy("user_id", "file").agg(percent(n_right(), F.count("*")).alias("score"))
    found = report.learning_paths(wrong, D.questions_with_options(spark, sf_dir), D.critical_paths(spark, sf_dir), own, sessions, order)
    return found.select("user_id", "priority", "file", "start_line", "concept")


# --- team matrix, totals by level ------------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("r12_team_matrix", """
WITH r AS (SELECT n_nationkey AS export_id, CASE WHEN n_nationkey % 5 = 0 THEN 'Teammate' ELSE n_name END AS name, CAST(c_custkey % 101 AS INT) AS score, c_mktsegment AS category
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT export_id, category, CAST(floor(avg(score) / 10 + 0.5) AS INT) AS score FROM r WHERE (export_id + length(category)) % 4 > 0 GROUP BY export_id, category),
o AS (SELECT export_id, name, CAST(floor(avg(score) + 0.5) AS INT) AS overall_score FROM r GROUP BY export_id, name),
k AS (SELECT *, CAST(rank() OVER (PARTITION BY category ORDER BY score DESC) AS INT) AS rank FROM c),
p AS (PIVOT k ON category IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') USING first(score) AS score, first(rank) AS rank GROUP BY export_id)
SELECT * FROM o LEFT JOIN p USING (export_id)""")
def r12_team_matrix(spark, sf_dir):
    """Mean scores in tens, so that many are equal; some teammates lack a category."""
    rows = D.table(spark, sf_dir, "customer").join(D.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        F.col("n_nationkey").alias("export_id"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("exported_by"),
        (F.col("c_custkey") % 101).cast("int").alias("score"), F.col("c_mktsegment").alias("category"),
    )
    tens = F.floor(F.avg("score") / 10 + 0.5).cast("int")
    some = rows.where((F.col("export_id") + F.length("category")) % 4 > 0)
    listed = some.groupBy("export_id", "category").agg(tens.alias("score")).groupBy("export_id").agg(F.collect_list(F.struct("category", "score")).alias("category_scores"))
    overall = rows.groupBy("export_id", "exported_by").agg(F.floor(F.avg("score") + 0.5).cast("int").alias("overall_score"))
    return report.team_matrix(overall.join(listed, "export_id", "left"), _SEGMENTS)


@query("c10_rollup", f"""
WITH cf AS ({D.CODE_FILES_SQL})
SELECT repo, language, CAST(grouping(repo) + grouping(language) AS INT) AS level, count(*) AS total_files, count(*) AS total_functions,
       count(DISTINCT file_id) AS names, true AS estimate_is_close FROM cf GROUP BY ROLLUP (repo, language)""")
def c10_rollup(spark, sf_dir):
    """Totals of repository and language, of repositories, and of all; from parts that were counted on their own."""
    files = D.code_files(spark, sf_dir)
    by = ["repo", "language"]
    odd = F.col("file_id").cast("bigint") % 2 == 1
    parts = metrics.rollup_parts(files.where(odd), by).unionByName(metrics.rollup_parts(files.where(~odd), by))
    exact = metrics.distinct_names(files, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("level").alias("_level"), "names")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "level"]]
    found = metrics.rolled_up(parts, by).join(exact, same)
    close = F.abs(F.col("about_names") - F.col("names")) <= 0.08 * F.col("names")
    return found.select(*by, "level", "total_files", "total_functions", "names", close.alias("estimate_is_close"))


# --- nested Python, pruned listing -----------------------------------------------------------

_PYTHON = """class C_N:
    def m_N(self):
        def inner(x):
            return x

        return inner(1)
    @property
    def p(self,
          y=1,
    ):
        return 1

async def top_N():
    pass
x = 1"""
# name, kind, first line, last line, depth, parent
_NESTED = [("C_", "class", 0, 11, 0, None), ("m_", "def", 1, 5, 1, "C_"), ("inner", "def", 2, 4, 2, "m_"), ("p", "def", 7, 11, 1, "C_"), ("top_", "async def", 12, 13, 0, None)]


def _named(column: str) -> str:
    return f"CASE WHEN {column} LIKE '%\\_' ESCAPE '\\' THEN concat({column}, p_partkey) ELSE {column} END"


@query("f8_nested_blocks", f"""
WITH t(name, kind, a, b, depth, parent) AS (VALUES {", ".join("(" + ", ".join(code._lit(v) for v in row) + ")" for row in _NESTED)})
SELECT CAST(p_partkey AS VARCHAR) AS file_id, {_named('name')} AS name, kind, CAST(a + p_size AS INT) AS start_line, CAST(b + p_size AS INT) AS end_line,
       CAST(depth * CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 4 END AS INT) AS indent, CAST(depth AS INT) AS depth, {_named('parent')} AS parent_name
FROM part CROSS JOIN t""")
def f8_nested_blocks(spark, sf_dir):
    """A class with methods and a function inside of one, behind as many lines as the part's size; indented by tabs in every second file."""
    part = D.spread(D.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", D.FILES_A_TASK)
    text = F.replace(F.lit(_PYTHON), F.lit("N"), F.col("p_partkey").cast("string"))
    tabbed = F.when(F.col("p_partkey") % 2 == 0, F.replace(text, F.lit("    "), F.lit("\t"))).otherwise(text)
    files = part.select(
        F.col("p_partkey").cast("string").alias("file_id"), F.lit("python").alias("language"),
        F.concat(F.repeat(F.lit("a = 0\n"), F.col("p_size").cast("int")), tabbed).alias("content"),
    )
    return nested_blocks(files).select("file_id", "name", "kind", "start_line", "end_line", "indent", "depth", "parent_name")


@query("s3_pruned_scan", code.CF.replace("cf AS", "WITH cf AS", 1) + """
SELECT CASE WHEN n % 3 = 0 THEN 'src' ELSE 'lib' END AS folder, CAST(sum(length(content) + 1) AS BIGINT) AS n_chars FROM cf WHERE n % 3 < 2 GROUP BY 1""")
def s3_pruned_scan(spark, sf_dir):
    """A tree with skipped folders at two depths: only the others are listed and read."""
    root = work_dir(spark, "tree")
    files = D.code_files(spark, sf_dir).withColumn("n", F.col("file_id").cast("bigint"))
    for at, folders in enumerate((["src"], ["lib"], ["node_modules", "lib/dist", "src/.cache/a"])):
        for folder in folders:
            files.where(F.col("n") % 3 == at).select("content").write.option("maxRecordsPerFile", 100_000).text(f"{root}/{folder}")
    found, _ = corpus.list_tree(spark, root, (".txt",))
    tree = corpus.read_files(spark, [path for path, _ in found])
    folder = F.regexp_extract(corpus.relative_to(F.col("path"), root.removeprefix("file:")), r"\A([^/]+)/", 1)
    return tree.groupBy(folder.alias("folder")).agg(F.sum(F.length("content")).cast("bigint").alias("n_chars"))
