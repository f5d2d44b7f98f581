"""Queries on sources, state and file classification (groups S and C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import line_count
from graspmeter.operators import classify, imports, metrics
from graspmeter.plans import driver_tables as D
from graspmeter.session import work_dir
from graspmeter.sources import corpus, exports, manifests, state
from graspmeter.sources.buckets import upsert_stream

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


MODULES = f"WITH mf AS ({D.MODULE_FILES_SQL}) "
DOCS = f"WITH d AS ({D.DOCUMENTS_SQL}) "
PAGES = f"WITH p AS ({D.PAGES_SQL}) "
CODE = f"WITH cf AS ({D.CODE_FILES_SQL}) "
_EXT = r"lower(regexp_extract(path, '[^/.][^/]*?(\.[^./]*)$', 1))"
_LANGUAGE = (
    f"CASE WHEN {_EXT} IN ('.ts', '.tsx') THEN 'typescript' WHEN {_EXT} IN ('.js', '.jsx') THEN 'javascript' "
    f"WHEN {_EXT} = '.py' THEN 'python' ELSE 'unknown' END"
)


# --- sources -------------------------------------------------------------------------------


@query("s1_scan_corpus")
def s1_scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the source texts as a tree of files in the shared folder and scan it back."""
    root = work_dir(spark, "corpus")
    # Each task writes its own files; a file is read back as one row, so its size is bounded.
    D.code_files(spark, sf_dir).select("content").write.option("maxRecordsPerFile", 100_000).text(root)
    # The text writer names its files .txt; their content is JavaScript.
    tree = corpus.read_tree(spark, root, "*.txt").withColumn(
        "path", F.regexp_replace("path", r"\.txt\z", ".js")
    )
    return corpus.select_files(tree, root).groupBy("language").agg(
        F.sum(F.length("content")).cast("bigint").alias("n_chars"),
        F.sum(line_count(F.col("content")) - 1).cast("bigint").alias("n_lines"),
    )


ORACLES["s1_scan_corpus"] = CODE + (
    "SELECT 'javascript' AS language, CAST(sum(length(content) + 1) AS BIGINT) AS n_chars, "
    "CAST(sum(length(content) - length(replace(content, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM cf"
)


@query("s2_supported_ext", MODULES + f"SELECT n, path FROM mf WHERE {_EXT} IN ('.ts', '.tsx', '.js', '.jsx', '.py')")
def s2_supported_ext(spark, sf_dir):
    files = D.module_files(spark, sf_dir)
    return files.where(corpus.is_supported(F.col("path"))).select(
        F.col("file_id").cast("bigint").alias("n"), "path"
    )


@query("s3_skip_dirs", MODULES + "SELECT n, path FROM mf WHERE NOT contains(path, '/node_modules/') AND NOT contains(path, '/.')")
def s3_skip_dirs(spark, sf_dir):
    files = D.module_files(spark, sf_dir)
    return files.where(~corpus.in_skipped_dir(F.col("path"))).select(
        F.col("file_id").cast("bigint").alias("n"), "path"
    )


@query("s4_scan_cap", MODULES + f"SELECT path, {_LANGUAGE} AS language FROM mf WHERE {_EXT} IN ('.ts', '.tsx', '.js', '.jsx', '.py') "
       f"AND NOT contains(path, '/node_modules/') AND NOT contains(path, '/.') ORDER BY path LIMIT {K.MAX_FILES}")
def s4_scan_cap(spark, sf_dir):
    listing = D.module_files(spark, sf_dir).select("path")
    return corpus.select_files(listing, "/ws", limit=K.MAX_FILES).select("path", "language")


@query("s5_relative_path", MODULES + "SELECT n, substr(path, 5) AS relative_path FROM mf")
def s5_relative_path(spark, sf_dir):
    return D.module_files(spark, sf_dir).select(
        F.col("file_id").cast("bigint").alias("n"), corpus.relative_to(F.col("path"), "/ws/").alias("relative_path")
    )


@query("s6_language_map", MODULES + f"SELECT n, {_LANGUAGE} AS language FROM mf")
def s6_language_map(spark, sf_dir):
    return D.module_files(spark, sf_dir).select(
        F.col("file_id").cast("bigint").alias("n"), corpus.language_of(F.col("path")).alias("language")
    )


@query("s7_line_count", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS line_count FROM documents")
def s7_line_count(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", line_count(F.col("text")).alias("line_count"))


@query("s8_priority_dir", MODULES + "SELECT n, regexp_matches(path_in_repo, '^(src|app|pages|lib|api)/') AS is_priority "
       "FROM (SELECT n, regexp_replace(path, '^/ws/[^/]*/', '') AS path_in_repo FROM mf)")
def s8_priority_dir(spark, sf_dir):
    files = D.module_files(spark, sf_dir)
    inside = F.regexp_replace("path", r"\A/ws/[^/]*/", "")
    return files.select(F.col("file_id").cast("bigint").alias("n"), corpus.in_priority_dir(inside).alias("is_priority"))


# Manifests: one project per part; which files it has depends on the part.
_JS_DEP = "['next', 'express', 'fastify', 'react', 'left-pad']"
_JS_DEV = "['jest', 'stripe', 'prisma', 'passport', 'none']"
_PY_DEP = "['django==4', 'flask', 'fastapi', 'sqlalchemy', 'pytest']"
MANIFESTS_SQL = f"""
SELECT p_partkey AS project, 'package.json' AS file_name,
       CASE WHEN p_partkey % 10 = 4 THEN '{{broken' ELSE
       concat('{{"dependencies": {{"', {_JS_DEP}[CAST(p_size % 5 AS INT) + 1], '": "^1.0"}}, "devDependencies": {{"',
              {_JS_DEV}[CAST(p_partkey % 5 AS INT) + 1], '": "2"}}}}') END AS content
FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'tsconfig.json', '{{}}' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'requirements.txt', {_PY_DEP}[CAST(p_size % 5 AS INT) + 1] FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, 'pyproject.toml', concat('[x] ', {_PY_DEP}[CAST(p_partkey % 5 AS INT) + 1]) FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 'notes.md', 'django' FROM part WHERE p_partkey % 4 = 3"""


def manifest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = D.table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def pick(words: str, no: str):
        return F.expr(f"array({words[1:-1]})[CAST({no} % 5 AS INT)]")

    package = F.when(F.col("p_partkey") % 10 == 4, "{broken").otherwise(
        F.concat(
            F.lit('{"dependencies": {"'), pick(_JS_DEP, "p_size"),
            F.lit('": "^1.0"}, "devDependencies": {"'), pick(_JS_DEV, "p_partkey"), F.lit('": "2"}}'),
        )
    )
    n = F.col("p_partkey")
    found = F.array(
        F.when(n % 2 == 0, F.struct(F.lit("package.json").alias("file_name"), package.alias("content"))),
        F.when(n % 3 == 0, F.struct(F.lit("tsconfig.json").alias("file_name"), F.lit("{}").alias("content"))),
        F.when(n % 5 == 1, F.struct(F.lit("requirements.txt").alias("file_name"), pick(_PY_DEP, "p_size").alias("content"))),
        F.when(n % 4 == 1, F.struct(F.lit("pyproject.toml").alias("file_name"),
                                    F.concat(F.lit("[x] "), pick(_PY_DEP, "p_partkey")).alias("content"))),
        F.when(n % 4 == 3, F.struct(F.lit("notes.md").alias("file_name"), F.lit("django").alias("content"))),
    )
    return part.select(n.alias("project"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m")).select(
        "project", "m.*"
    )


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(js, '\"{w}\":')" for w in words) + ")"


def _txt(*words: str) -> str:
    return "(" + " OR ".join(f"contains(txt, '{w}')" for w in words) + ")"


_PROFILE_SQL = f"""
WITH m AS ({MANIFESTS_SQL.replace('{{', '{').replace('}}', '}')}),
g AS (SELECT project, max(content) FILTER (WHERE file_name = 'package.json') AS package,
             max(content) FILTER (WHERE file_name = 'tsconfig.json') AS ts,
             coalesce(max(content) FILTER (WHERE file_name = 'requirements.txt'),
                      max(content) FILTER (WHERE file_name = 'pyproject.toml')) AS txt
      FROM m GROUP BY project),
h AS (SELECT *, CASE WHEN package IS NOT NULL AND package <> '{{broken' THEN package ELSE '' END AS js FROM g)
SELECT project,
  CASE WHEN package = '{{broken' THEN 'typescript' WHEN package IS NOT NULL AND ts IS NOT NULL THEN 'typescript'
       WHEN package IS NOT NULL THEN 'javascript' WHEN txt IS NOT NULL THEN 'python' ELSE 'unknown' END AS primary_language,
  CASE WHEN package IS NOT NULL THEN
         CASE WHEN {_has('next')} THEN 'Next.js' WHEN {_has('express')} THEN 'Express'
              WHEN {_has('fastify')} THEN 'Fastify' WHEN {_has('react')} THEN 'React' END
       ELSE CASE WHEN {_txt('django')} THEN 'Django' WHEN {_txt('flask')} THEN 'Flask' WHEN {_txt('fastapi')} THEN 'FastAPI' END
  END AS framework,
  coalesce(CASE WHEN package IS NOT NULL THEN {_has('passport')} ELSE false END, false) AS has_auth,
  coalesce(CASE WHEN package IS NOT NULL THEN {_has('stripe')} ELSE {_txt('stripe')} END, false) AS has_payments,
  coalesce(CASE WHEN package IS NOT NULL THEN {_has('prisma')} ELSE {_txt('sqlalchemy', 'django')} END, false) AS has_database,
  coalesce(CASE WHEN package IS NOT NULL THEN {_has('jest')} ELSE {_txt('pytest', 'unittest')} END, false) AS has_testing
FROM h"""


@query("s9_manifest_profile_js", f"SELECT * FROM ({_PROFILE_SQL}) x WHERE primary_language IN ('typescript', 'javascript')")
def s9_manifest_profile_js(spark, sf_dir):
    return manifests.project_profiles(manifest_table(spark, sf_dir)).where(
        F.col("primary_language").isin("typescript", "javascript")
    )


@query("s10_manifest_profile_py", f"SELECT * FROM ({_PROFILE_SQL}) x WHERE primary_language NOT IN ('typescript', 'javascript')")
def s10_manifest_profile_py(spark, sf_dir):
    return manifests.project_profiles(manifest_table(spark, sf_dir)).where(
        ~F.col("primary_language").isin("typescript", "javascript")
    )


# --- team documents: an owner per customer, a file per order priority, a category per status


def _team_tables(spark, sf_dir):
    """Scores are aggregated, so a document has at most five files and three categories."""
    orders = D.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("user "), "o_custkey").alias("exported_by"),
        F.concat(F.lit("src/"), "o_orderpriority").alias("file"),
        F.col("o_orderstatus").alias("category"),
        (F.col("o_orderkey") % 101).alias("score"),
    )
    mean = F.floor(F.avg("score") + 0.5).cast("int")
    files = orders.groupBy("exported_by", "file").agg(mean.alias("score"), F.count("*").alias("question_count"))
    files = files.withColumns({"relative_path": F.col("file"), "risk_level": F.length("file")})
    categories = orders.groupBy("exported_by", "category").agg(
        mean.alias("score"), F.count("*").alias("question_count")
    )
    overall = orders.groupBy("exported_by").agg(mean.alias("overall_score"), F.count("*").alias("session_count"))
    return overall, files, categories


EXPORTED_AT = 1767225600000

_TEAM_SQL = """
WITH r AS (SELECT concat('user ', o_custkey) AS exported_by, concat('src/', o_orderpriority) AS file,
                  o_orderstatus AS category, o_orderkey % 101 AS score FROM orders),
fil AS (SELECT exported_by, file, CAST(floor(avg(score) + 0.5) AS INT) AS score, count(*) AS n FROM r GROUP BY exported_by, file),
cat AS (SELECT exported_by, category, CAST(floor(avg(score) + 0.5) AS INT) AS score, count(*) AS n FROM r GROUP BY exported_by, category),
o AS (SELECT exported_by, CAST(floor(avg(score) + 0.5) AS INT) AS overall_score, count(*) AS session_count FROM r GROUP BY exported_by)
"""


@query("s11_team_export", _TEAM_SQL + f"""
SELECT exported_by, concat('{{"exportedBy":"', exported_by, '","exportedAt":{EXPORTED_AT},"overallScore":', overall_score,
  ',"fileScores":[', f.js, '],"categoryScores":[', c.js, '],"sessionCount":', session_count, '}}') AS value
FROM o
JOIN (SELECT exported_by, string_agg(concat('{{"file":"', file, '","relativePath":"', file, '","score":', score,
        ',"questionCount":', n, ',"riskLevel":', length(file), ',"lastUpdated":{EXPORTED_AT}}}'), ',' ORDER BY file) AS js
      FROM fil GROUP BY exported_by) f USING (exported_by)
JOIN (SELECT exported_by, string_agg(concat('{{"category":"', category, '","score":', score, ',"questionCount":',
        n, '}}'), ',' ORDER BY category) AS js FROM cat GROUP BY exported_by) c USING (exported_by)""")
def s11_team_export(spark, sf_dir):
    return exports.team_exports(*_team_tables(spark, sf_dir), EXPORTED_AT)


def _documents_with_broken(spark, sf_dir):
    docs = exports.team_exports(*_team_tables(spark, sf_dir), EXPORTED_AT)
    broken = F.when(F.col("exported_by").endswith("7"), F.substring("value", F.lit(1), F.length("value") - 1))
    return docs.select(F.col("exported_by").alias("source"), F.coalesce(broken, "value").alias("value"))


@query("s12_team_import", _TEAM_SQL + """
SELECT exported_by AS source, NOT exported_by LIKE '%7' AS accepted,
       CASE WHEN NOT exported_by LIKE '%7' THEN overall_score END AS overall_score,
       CASE WHEN NOT exported_by LIKE '%7' THEN (SELECT count(*) FROM fil WHERE fil.exported_by = o.exported_by) END AS n_files FROM o""")
def s12_team_import(spark, sf_dir):
    good, rejected = exports.parse_exports(_documents_with_broken(spark, sf_dir))
    accepted = good.select(
        "source", F.lit(True).alias("accepted"), "overall_score", F.size("file_scores").cast("bigint").alias("n_files")
    )
    dropped = rejected.select(
        "source", F.lit(False).alias("accepted"), F.lit(None).cast("int").alias("overall_score"),
        F.lit(None).cast("bigint").alias("n_files"),
    )
    return accepted.unionByName(dropped)


@query("s13_upsert_session", """
SELECT session_id, arg_max(score, (v, s)) AS score, CAST(max(v) AS BIGINT) AS version FROM (
  SELECT o_orderkey AS session_id, CAST(o_orderkey % 101 AS INT) AS score, 1 AS v, 0 AS s FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL
  SELECT l_orderkey, CAST(max(l_quantity) AS INT), CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END, 1 FROM lineitem GROUP BY l_orderkey) x
GROUP BY session_id""")
def s13_upsert_session(spark, sf_dir):
    current = D.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("session_id"),
        (F.col("o_orderkey") % 101).cast("int").alias("score"),
        F.lit(1).cast("bigint").alias("version"),
    )
    changes = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(
        F.max("l_quantity").cast("int").alias("score")
    ).withColumn("version", F.when(F.col("session_id") % 2 == 0, 2).otherwise(0).cast("bigint"))
    return state.upsert(current, changes, "session_id", F.col("version"))


@query("s13_upsert_stream", """
SELECT user_id AS session_id, max(event_id) AS version, arg_max(event_type, event_id) AS last_event FROM events GROUP BY user_id""")
def s13_upsert_stream(spark, sf_dir):
    """Saved rows as a stream of changes: the newest event of each user stays, over ten micro-batches."""
    changes = D.event_periods(spark, sf_dir, 10).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("version"), F.col("event_type").alias("last_event")
    )
    return upsert_stream(changes, work_dir(spark, "sessions"), "session_id", "version", buckets=16).read()


@query("s14_mark_shown", "SELECT DISTINCT l_partkey AS question_id FROM lineitem UNION SELECT p_partkey FROM part WHERE p_size < 10")
def s14_mark_shown(spark, sf_dir):
    shown = D.table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("question_id"))
    return state.mark_shown(shown, D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id")))


@query("s14_mark_shown_by_user", """
SELECT DISTINCT o_custkey AS user_id, l_partkey AS question_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION SELECT c_custkey, c_custkey % 100 + 1 FROM customer""")
def s14_mark_shown_by_user(spark, sf_dir):
    key = F.col("c_custkey")
    shown = D.table(spark, sf_dir, "customer").select(key.alias("user_id"), (key % 100 + 1).alias("question_id"))
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    items = D.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("question_id"))
    return state.mark_shown(shown, items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), ["user_id"])


@query("s15_reset_state", "SELECT 'sessions' AS name, o_orderkey AS key, o_custkey AS user_id FROM orders")
def s15_reset_state(spark, sf_dir):
    """Of two saved tables one is reset; what is left is shown."""
    base = work_dir(spark, "state")
    state.save(D.sessions(spark, sf_dir).select(F.col("session_id").alias("key"), "user_id"), base, "sessions")
    state.save(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(None).cast("bigint").alias("user_id")), base, "shown_questions")
    state.reset_all(spark, base, ["shown_questions"])
    left = [state.load(spark, base, name).select(F.lit(name).alias("name"), "key", "user_id") for name in ("sessions", "shown_questions")]
    return left[0].unionByName(left[1])


@query("s16_pin_unpin", """
SELECT p_brand AS file FROM part WHERE p_size = 1
UNION SELECT p_brand FROM part WHERE p_size BETWEEN 2 AND 20
EXCEPT SELECT p_brand FROM part WHERE p_size = 50 AND p_name LIKE '% widget'""")
def s16_pin_unpin(spark, sf_dir):
    part = D.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "file")
    pinned = part.where("p_size = 1").select("file").distinct()
    more = state.pin(pinned, part.where("p_size between 2 and 20").select("file"))
    return state.unpin(more, part.where("p_size = 50 and p_name like '% widget'").select("file"))


# --- classification ------------------------------------------------------------------------


def _matches_sql(category: str, rank: int, source: str) -> str:
    words = f"list_filter({_sql_list(K.CATEGORY_WORDS[category])}, lambda w: contains(low, w) OR contains(base, w))"
    if category == "api-route":
        dirs = f"list_filter({_sql_list(K.ROUTE_DIRS)}, lambda w: list_contains(string_split(lower(path), '/'), w))"
        words = f"list_concat({words}, list_transform({dirs}, lambda w: concat('dir:', w)))"
    return f"SELECT file_id, {rank} AS rank, '{category}' AS category, {words} AS words FROM {source}"


def _classes_sql(files_sql: str) -> str:
    union = " UNION ALL ".join(_matches_sql(c, i, "f") for i, c in enumerate(K.CATEGORY_WORDS))
    return (
        f"WITH f AS (SELECT file_id, path, lower(content) AS low, lower(regexp_extract(path, '[^/]*$')) AS base "
        f"FROM ({files_sql}) x), m AS (SELECT * FROM ({union}) y WHERE len(words) > 0), "
        "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rank) AS rn FROM m) z WHERE rn = 1), "
        "r AS (SELECT file_id, category, words, CAST(floor(least(10, 3 + 1.5 * len(words)) + 0.5) AS INT) AS risk_level FROM c) "
    )


@query("c1_keyword_match", _classes_sql(D.DOCUMENTS_SQL) + "SELECT file_id, category, array_to_string(words, ',') AS words FROM m")
def c1_keyword_match(spark, sf_dir):
    return classify.keyword_matches(D.documents(spark, sf_dir)).select(
        "file_id", "category", F.array_join("matched", ",").alias("words")
    )


@query("c2_route_dir_match", CODE + "SELECT file_id, CASE WHEN contains(path, '/api/') THEN 'dir:api' ELSE '' END AS dirs FROM cf")
def c2_route_dir_match(spark, sf_dir):
    return D.code_files(spark, sf_dir).select(
        "file_id", F.array_join(classify.route_dirs(F.col("relative_path")), ",").alias("dirs")
    )


@query("c3_first_category_wins", _classes_sql(D.PAGES_SQL) + "SELECT file_id, category, array_to_string(words, ',') AS words FROM r")
def c3_first_category_wins(spark, sf_dir):
    return classify.critical_paths(D.pages(spark, sf_dir)).select(
        "file_id", "category", F.array_join("matched_patterns", ",").alias("words")
    )


@query("c4_risk_level", _classes_sql(D.CODE_FILES_SQL) + "SELECT file_id, category, risk_level FROM r")
def c4_risk_level(spark, sf_dir):
    return classify.critical_paths(D.code_files(spark, sf_dir)).select("file_id", "category", "risk_level")


@query("c5_file_risk", _classes_sql(D.DOCUMENTS_SQL) + "SELECT f.file_id, coalesce(risk_level, 1) AS risk_level, "
       "coalesce(array_to_string(words, ','), '') AS words FROM f LEFT JOIN r USING (file_id)")
def c5_file_risk(spark, sf_dir):
    return classify.with_risk(D.documents(spark, sf_dir)).select(
        "file_id", "risk_level", F.array_join("critical_patterns", ",").alias("words")
    )


_BRANCHES = r"len(regexp_extract_all(content, '\bif\b|\belse\b|\bswitch\b|\bcase\b|\?\s'))"


@query("c6_branch_count_file", DOCS + f"SELECT file_id, CAST({_BRANCHES} AS INT) AS branch_count FROM d")
def c6_branch_count_file(spark, sf_dir):
    return D.documents(spark, sf_dir).select("file_id", metrics.file_branch_count(F.col("content")).alias("branch_count"))


def _depth_sql(source: str) -> str:
    """Depth by prefix sums: the running sum less its lowest value so far."""
    return (
        f"t AS (SELECT file_id, generate_subscripts(b, 1) AS i, unnest(b) AS ch "
        f"FROM (SELECT file_id, regexp_extract_all(content, '[{{}}()]') AS b FROM {source}) x), "
        "s AS (SELECT file_id, i, sum(CASE WHEN ch IN ('{', '(') THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY i) AS s FROM t), "
        "u AS (SELECT file_id, s - least(0, min(s) OVER (PARTITION BY file_id ORDER BY i)) AS d FROM s), "
        "dep AS (SELECT file_id, CAST(max(d) AS INT) AS depth FROM u GROUP BY file_id)"
    )


@query("c7_nesting_depth_file", PAGES.rstrip() + ", " + _depth_sql("p") +
       " SELECT p.file_id, coalesce(depth, 0) AS nesting_depth FROM p LEFT JOIN dep USING (file_id)")
def c7_nesting_depth_file(spark, sf_dir):
    return D.pages(spark, sf_dir).select("file_id", metrics.nesting_depth(F.col("content"), "{(", "})").alias("nesting_depth"))


@query("c8_complexity_score", _classes_sql(D.PAGES_SQL).rstrip() + f", p AS ({D.PAGES_SQL}), " + _depth_sql("p") + f"""
SELECT p.file_id, len(string_split(content, chr(10))) AS line_count, CAST({_BRANCHES} AS INT) AS branch_count,
       coalesce(risk_level, 1) AS risk_level,
       CAST(least(10, floor(coalesce(risk_level, 1) * 0.4::DOUBLE + least(3.0::DOUBLE, len(string_split(content, chr(10))) / 200::DOUBLE)
         + least(3.0::DOUBLE, {_BRANCHES} / 10::DOUBLE) + least(2.0::DOUBLE, coalesce(depth, 0) / 5::DOUBLE) + 0.5)) AS INT) AS complexity_score
FROM p LEFT JOIN dep USING (file_id) LEFT JOIN r USING (file_id)""".replace("len(string_split(content, chr(10))) AS", "CAST(len(string_split(content, chr(10))) AS INT) AS"))
def c8_complexity_score(spark, sf_dir):
    return metrics.file_metrics(classify.with_risk(D.pages(spark, sf_dir))).select(
        "file_id", "line_count", "branch_count", "risk_level", "complexity_score"
    )


@query("c9_symbol_extract", MODULES + """
SELECT file_id, kind, name, line AS start_line, line + span AS end_line FROM (
  SELECT file_id, 'function' AS kind, 'go' AS name, 8 AS line, 10 AS span FROM mf WHERE language <> 'python'
  UNION ALL SELECT file_id, 'function', 'f', 9, 10 FROM mf WHERE language <> 'python'
  UNION ALL SELECT file_id, 'class', concat('C_', n), 3, 30 FROM mf WHERE language <> 'python'
  UNION ALL SELECT file_id, 'class', 'D', 7, 30 FROM mf WHERE language <> 'python'
  UNION ALL SELECT file_id, 'class', 'D', 8, 20 FROM mf WHERE language = 'python') x""")
def c9_symbol_extract(spark, sf_dir):
    return metrics.symbols(D.module_files(spark, sf_dir))


@query("c10_workspace_totals", _classes_sql(D.CODE_FILES_SQL).rstrip() + f", cf AS ({D.CODE_FILES_SQL}) " + """
SELECT repo, count(*) AS total_files, count(*) AS total_functions, count(r.file_id) AS total_critical
FROM cf LEFT JOIN r USING (file_id) GROUP BY repo""")
def c10_workspace_totals(spark, sf_dir):
    return metrics.totals(D.code_files(spark, sf_dir), ["repo"])


@query("c11_import_edges", MODULES + """
SELECT file_id, concat('./m_', p_size) AS target FROM mf
UNION ALL SELECT file_id, concat('../d1/m_', n % 11) FROM mf""")
def c11_import_edges(spark, sf_dir):
    return imports.import_edges(D.module_files(spark, sf_dir)).select("file_id", "target")


@query("c12_dependency_nodes", MODULES + """
SELECT module, count(DISTINCT relative_path) AS imported_by FROM (
  SELECT concat('src/d', p_size % 5, '/m_', p_size) AS module, relative_path FROM mf
  UNION ALL SELECT concat('src/d1/m_', n % 11), relative_path FROM mf) x GROUP BY module""")
def c12_dependency_nodes(spark, sf_dir):
    return imports.in_degree(imports.import_edges(D.module_files(spark, sf_dir)))


@query("c12_dependency_lists", MODULES + """
SELECT file_id, relative_path AS file, concat('./m_', p_size, ' ../d1/m_', n % 11) AS calls, 0 AS risk_level, 0 AS n_called_by FROM mf""")
def c12_dependency_lists(spark, sf_dir):
    return imports.dependency_nodes(D.module_files(spark, sf_dir)).select(
        "file_id", "file", F.array_join("calls", " ").alias("calls"), "risk_level",
        F.size("called_by").alias("n_called_by"),
    )
