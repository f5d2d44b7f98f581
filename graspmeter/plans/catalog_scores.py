"""Queries on grading, scores and reports (groups G and R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.operators import grading, report, scoring
from graspmeter.plans import driver_tables as D
from graspmeter.plans import jobs
from graspmeter.session import materialize

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pct(right: str, total: str) -> str:
    return f"CAST(floor({right} / {total}::DOUBLE * 100 + 0.5) AS INT)"


A = f"a AS ({D.ANSWERS_SQL})"
Q = f"q AS ({D.QUESTIONS_SQL})"
S = f"s AS ({D.SESSIONS_SQL})"
C = f"c AS ({D.CRITICAL_SQL})"
FACTS = f"{A}, {Q}, f AS (SELECT a.*, q.file, q.category FROM a JOIN q USING (question_id))"
RIGHT = "count(*) FILTER (WHERE is_correct)"
FILE_SCORES = f"""{FACTS}, {C}, fs AS (
  SELECT g.file, {_pct('n_right', 'question_count')} AS score, question_count, coalesce(risk_level, 1) AS risk_level
  FROM (SELECT file, {RIGHT} AS n_right, count(*) AS question_count FROM f GROUP BY file) g LEFT JOIN c USING (file))"""
ZONES = f"""{FILE_SCORES}, z AS (
  SELECT c.abs_file AS file, c.file AS relative_path, c.category, c.risk_level, coalesce(score, 0) AS understanding_score,
         c.risk_level * (1 - coalesce(score, 0) / 100::DOUBLE) AS danger_score
  FROM c LEFT JOIN fs USING (file) WHERE c.risk_level >= 7 AND coalesce(score, 0) <= 40)"""
SESSION_SCORES = f"{A}, ss AS (SELECT session_id, {_pct(RIGHT, 'count(*)')} AS score, {RIGHT} AS correct, count(*) AS answered FROM a GROUP BY session_id)"
TIMELINE = f"{SESSION_SCORES}, {S}, t AS (SELECT user_id, session_id, end_ts, coalesce(score, 0) AS score FROM s LEFT JOIN ss USING (session_id) WHERE end_ts IS NOT NULL)"

# An option's text, by its number 0..3.
_TEXTS = "[" + ", ".join("'" + t + "'" for t in D.OPTION_TEXTS) + "]"


def _text(no: str) -> str:
    return f"concat({_TEXTS}[CAST((question_id + {no}) % 8 AS INT) + 1], ' ', question)"


_CHOSEN = _text("(ascii(selected_label) - 65)")
_OK = "(selected_label <> 'E' AND selected_label = chr(65 + right_no))"
_PLACE = "concat(file, ':', start_line + 1)"
_GRADED = f"{A}, {Q}, j AS (SELECT a.session_id, a.pos, a.question_id, a.tie_1, a.tie_2, a.ts, selected_label, file, start_line, difficulty, question, explanation, right_no, {_OK} AS ok FROM a JOIN q USING (question_id))"
_KEYS = ["session_id", "pos", "question_id", "tie_1"]


def _facts(spark, sf_dir):
    return scoring.answer_facts(D.answers(spark, sf_dir), D.questions(spark, sf_dir))


def _file_scores(spark, sf_dir):
    return scoring.file_scores(_facts(spark, sf_dir), D.critical_paths(spark, sf_dir))


def _zones(spark, sf_dir):
    return scoring.danger_zones(D.critical_paths(spark, sf_dir), _file_scores(spark, sf_dir))


def _graded(spark, sf_dir, detailed=False):
    return grading.grade(D.answers(spark, sf_dir), D.questions_with_options(spark, sf_dir), detailed)


# --- grading --------------------------------------------------------------------------------


@query("g1_grade_answer", f"""WITH {_GRADED}
SELECT session_id, pos, question_id, tie_1, ok AS is_correct, CASE WHEN ok THEN 'moderate' ELSE 'surface' END AS understanding_depth,
  CASE WHEN selected_label = 'E' THEN 'Could not evaluate answer.' WHEN ok THEN concat('Correct! ', explanation)
       ELSE concat('Incorrect. The correct answer was: "', {_text('right_no')}, '"', chr(10), chr(10), explanation) END AS feedback,
  CASE WHEN selected_label <> 'E' AND NOT ok THEN concat('Review the code at ', {_PLACE}) END AS concept_gap FROM j""")
def g1_grade_answer(spark, sf_dir):
    return _graded(spark, sf_dir).select(*_KEYS, "is_correct", "understanding_depth", "feedback", "concept_gap")


@query("g2_grade_answer_depth", f"""WITH {_GRADED}
SELECT session_id, pos, question_id, tie_1, ok AS is_correct,
  CASE WHEN NOT ok THEN 'surface' WHEN difficulty >= 4 THEN 'deep' WHEN difficulty >= 2 THEN 'moderate' ELSE 'surface' END AS understanding_depth,
  CASE WHEN selected_label = 'E' THEN 'Unable to evaluate answer: question options are malformed.' WHEN ok THEN concat('Correct! ', explanation)
       ELSE concat('Incorrect. You selected: "', {_CHOSEN}, '"', chr(10), chr(10), 'The correct answer is: "', {_text('right_no')}, '"', chr(10), chr(10), explanation) END AS feedback FROM j""")
def g2_grade_answer_depth(spark, sf_dir):
    return _graded(spark, sf_dir, True).select(*_KEYS, "is_correct", "understanding_depth", "feedback")


_GAPS = [m[2].replace("'", "''") for m in grading.MISCONCEPTIONS]


@query("g3_misconception", f"""WITH {_GRADED}, w AS (SELECT *, lower({_CHOSEN}) AS low FROM j WHERE selected_label <> 'E' AND NOT ok)
SELECT session_id, pos, question_id, tie_1,
  CASE WHEN contains(low, 'express') AND contains(low, 'catch') THEN '{_GAPS[0]}'
       WHEN contains(low, 'typescript') AND (contains(low, 'prevent') OR contains(low, 'type system')) THEN '{_GAPS[1]}'
       WHEN contains(low, 'automatically') OR contains(low, 'retries') THEN '{_GAPS[2]}'
       WHEN contains(low, 'global') AND contains(low, 'handler') THEN '{_GAPS[3]}'
       WHEN contains(low, 'returns null') OR contains(low, 'returns undefined') THEN '{_GAPS[4]}'
       WHEN contains(low, 'gitignore') THEN '{_GAPS[5]}'
       ELSE concat('Review the code at ', {_PLACE}, ' to understand the actual behavior.') END AS concept_gap FROM w""")
def g3_misconception(spark, sf_dir):
    return _graded(spark, sf_dir, True).where(F.col("concept_gap").isNotNull()).select(*_KEYS, "concept_gap")


@query("g4_session_score", f"WITH {SESSION_SCORES} SELECT * FROM ss")
def g4_session_score(spark, sf_dir):
    return grading.session_scores(D.answers(spark, sf_dir))


def _adaptive_sql(key: str, source: str, order: str, start: str) -> str:
    """Fold of one key's answers with a list reduction; the state is [level, right, wrong]."""
    return f"""
l AS (SELECT {key} AS key, list(is_correct ORDER BY {order}) AS steps, {start} AS start FROM {source} GROUP BY {key}),
r AS (SELECT key, len(steps) AS answered, list_reduce(
    list_concat([[start, 0, 0]], list_transform(steps, lambda o: [CASE WHEN o THEN 1 ELSE 0 END])),
    lambda acc, o: CASE
      WHEN o[1] = 1 AND acc[2] >= 2 THEN [least(5, acc[1] + 1), 0, 0]
      WHEN o[1] = 1 THEN [acc[1], acc[2] + 1, 0]
      WHEN acc[3] >= 1 THEN [greatest(1, acc[1] - 1), 0, 0]
      ELSE [acc[1], 0, acc[3] + 1] END) AS st FROM l)
SELECT key AS {key}, CAST(answered AS BIGINT) AS answered, CAST(st[1] AS INT) AS level,
       CAST(st[2] AS INT) AS right_streak, CAST(st[3] AS INT) AS wrong_streak FROM r"""


@query("g5_adaptive_difficulty", f"WITH {A}, {Q}, qa AS (SELECT q.file, a.* FROM a JOIN q USING (question_id)),"
       + _adaptive_sql("file", "qa", "ts, session_id, pos, question_id, tie_1, tie_2", "3"))
def g5_adaptive_difficulty(spark, sf_dir):
    """Level per file, so that the keys are few and hot."""
    return grading.adaptive_difficulty(
        _facts(spark, sf_dir), "file", ["ts", "session_id", *D.ANSWER_ORDER]
    )


@query("g6_difficulty_override", f"WITH {A}," + _adaptive_sql(
    "session_id", "a", "pos, question_id, tie_1, tie_2",
    "CASE WHEN session_id % 9 > 0 THEN CAST(greatest(1, least(5, session_id % 9)) AS INT) ELSE 3 END"))
def g6_difficulty_override(spark, sf_dir):
    """Level per session, each starting with a chosen level (0: none) out of 0..8."""
    chosen = (F.col("session_id") % 9).cast("int")
    return grading.adaptive_difficulty(
        D.answers(spark, sf_dir), "session_id", D.ANSWER_ORDER, start=grading.start_level(chosen)
    )


@query("g7_record_answer", f"""WITH {_GRADED}
SELECT session_id, pos, question_id, tie_1, ok AS is_correct, selected_label FROM j WHERE ts >= TIMESTAMP '2000-01-01'
UNION ALL SELECT session_id, pos, question_id, tie_1, is_correct, selected_label FROM a WHERE ts < TIMESTAMP '2000-01-01'""")
def g7_record_answer(spark, sf_dir):
    columns = [*_KEYS, "is_correct", "selected_label"]
    log = D.answers(spark, sf_dir).where("ts < '2000-01-01'").select(*columns)
    return grading.record_answers(log, _graded(spark, sf_dir).where("ts >= '2000-01-01'"))


# --- scores ---------------------------------------------------------------------------------


@query("r1_answer_facts", f"WITH {FACTS} SELECT session_id, pos, question_id, tie_1, is_correct, file, category FROM f")
def r1_answer_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select(*_KEYS, "is_correct", "file", "category")


@query("r2_file_scores", f"WITH {FILE_SCORES} SELECT file, file AS relative_path, score, question_count, risk_level FROM fs")
def r2_file_scores(spark, sf_dir):
    return _file_scores(spark, sf_dir)


@query("r3_category_scores", f"WITH {FACTS} SELECT category, {_pct(RIGHT, 'count(*)')} AS score, count(*) AS question_count FROM f GROUP BY category")
def r3_category_scores(spark, sf_dir):
    return scoring.category_scores(_facts(spark, sf_dir))


_OVERALL = "CAST(floor(sum(score * CASE WHEN risk_level >= 7 THEN 3 ELSE 1 END) / sum(CASE WHEN risk_level >= 7 THEN 3 ELSE 1 END)::DOUBLE + 0.5) AS INT)"


@query("r4_overall_score", f"WITH {FILE_SCORES} SELECT {_OVERALL} AS overall_score, count(*) AS n_files FROM fs")
def r4_overall_score(spark, sf_dir):
    return scoring.overall_score(_file_scores(spark, sf_dir))


@query("r5_danger_zones", f"WITH {ZONES} SELECT file, relative_path, category, risk_level, understanding_score, round(danger_score, 6) AS danger_score FROM z")
def r5_danger_zones(spark, sf_dir):
    return scoring.ranked_zones(_zones(spark, sf_dir)).select(
        "file", "relative_path", "category", "risk_level", "understanding_score", F.round("danger_score", 6).alias("danger_score")
    )


def _timeline(spark, sf_dir):
    return report.progress_timeline(
        D.sessions(spark, sf_dir), grading.session_scores(D.answers(spark, sf_dir))
    )


@query("r6_timeline", f"WITH {TIMELINE} SELECT user_id, session_id, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, score FROM t")
def r6_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir).withColumn("end_ts", F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss"))


@query("r7_trend", f"""WITH {TIMELINE}, n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_ts DESC, session_id DESC) AS rn FROM t),
g AS (SELECT user_id, arg_max(score, rn) AS first_score, arg_min(score, rn) AS last_score, count(*) AS n_recent FROM n WHERE rn <= 3 GROUP BY user_id)
SELECT user_id, first_score, last_score, n_recent, CASE WHEN n_recent < 2 THEN 'stable' WHEN last_score - first_score >= 10 THEN 'improving'
  WHEN last_score - first_score <= -10 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def r7_trend(spark, sf_dir):
    return report.trend(_timeline(spark, sf_dir))


def _wrong_answers(spark, sf_dir):
    """Wrong answers with their place and the start of their session."""
    key = grading.answer_key(D.questions_with_options(spark, sf_dir)).select(
        "question_id", "right_label", "file", "start_line"
    )
    wrong = D.answers(spark, sf_dir).join(key, "question_id").where(F.col("selected_label") != F.col("right_label"))
    return wrong.join(D.sessions(spark, sf_dir).select("session_id", "start_ts"), "session_id")


@query("r8_learning_path", f"""WITH {ZONES}, {S},
j AS (SELECT a.*, q.start_line, q.end_line, q.file AS qfile, q.category AS qcat, q.question, q.explanation, q.right_no, s.start_ts,
        {_OK} AS ok FROM a JOIN q USING (question_id) JOIN s USING (session_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY qfile, start_line ORDER BY start_ts DESC, session_id DESC, pos, question_id, tie_1, tie_2) AS nth FROM j WHERE NOT ok),
w10 AS (SELECT *, row_number() OVER (ORDER BY start_ts DESC, session_id DESC, pos, question_id, tie_1, tie_2) AS rank FROM w WHERE nth = 1),
u AS (SELECT 0 AS branch, rank, qfile AS file, start_line, end_line, concat(replace(qcat, '-', ' '), ' — ', left(question, 60), '…') AS concept,
        CASE WHEN selected_label = 'E' THEN 'Could not evaluate answer.' ELSE concat('Incorrect. The correct answer was: "', {_text('right_no')}, '"', chr(10), chr(10), explanation) END AS why_it_matters
      FROM w10 WHERE rank <= 10
      UNION ALL SELECT 1, row_number() OVER (ORDER BY danger_score DESC, relative_path), relative_path, 0, 0, category,
        concat('Risk level ', risk_level, '/5 — understanding score ', understanding_score, '%') FROM z)
SELECT CAST(row_number() OVER (ORDER BY branch, rank) AS INT) AS priority, file, start_line, end_line, concept, why_it_matters
FROM u ORDER BY branch, rank LIMIT 10""")
def r8_learning_path(spark, sf_dir):
    order = [F.unix_micros(F.col("start_ts").cast("timestamp")) * -1, -F.col("session_id"), *[F.col(c) for c in D.ANSWER_ORDER]]
    scores = materialize(_file_scores(spark, sf_dir), "file_scores")
    zones = scoring.danger_zones(D.critical_paths(spark, sf_dir), scores)
    return report.learning_path(
        _wrong_answers(spark, sf_dir), D.questions_with_options(spark, sf_dir), zones, scores, order
    )


@query("r8_learning_path_no_answers", f"""WITH {ZONES},
u AS (SELECT CAST(row_number() OVER (ORDER BY danger_score DESC, relative_path) AS INT) AS priority, * FROM z)
SELECT priority, relative_path AS file, category AS concept FROM u WHERE priority <= 10""")
def r8_learning_path_no_answers(spark, sf_dir):
    none = _wrong_answers(spark, sf_dir).where("selected_label is null")
    scores = materialize(_file_scores(spark, sf_dir), "file_scores")
    zones = scoring.danger_zones(D.critical_paths(spark, sf_dir), scores)
    path = report.learning_path(
        none, D.questions_with_options(spark, sf_dir), zones, scores, [F.col("session_id")]
    )
    return path.select("priority", "file", "concept")


def _band(score: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN '{label}'" for low, label in bands) + " END"


@query("r9_score_band", f"WITH {FILE_SCORES} SELECT file, score, {_band('score', K.REPORT_BANDS)} AS report_band, {_band('score', K.FILE_COLORS)} AS color, {_band('score', K.QUIZ_BANDS)} AS quiz_band FROM fs")
def r9_score_band(spark, sf_dir):
    return report.score_bands(_file_scores(spark, sf_dir).select("file", "score"))


@query("r10_lowest_files", f"WITH {FILE_SCORES} SELECT file, score, question_count FROM fs ORDER BY score, file LIMIT 10")
def r10_lowest_files(spark, sf_dir):
    return report.lowest_files(_file_scores(spark, sf_dir)).select("file", "score", "question_count")


@query("r11_history", f"""WITH {_GRADED}, {S},
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, question_id ORDER BY pos, tie_1, tie_2) AS nth FROM j) x WHERE nth = 1),
tot AS (SELECT session_id, count(*) FILTER (WHERE ok) AS n_right, count(*) AS n_answered FROM j GROUP BY session_id),
num AS (SELECT session_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, session_id) AS session_no FROM s)
SELECT num.user_id, session_no, li.l_orderkey AS session_id, coalesce(n_right, 0) AS n_right, coalesce(n_answered, 0) AS n_answered,
  concat_ws('-', l_linenumber, l_suppkey) AS question_nth, q.question, coalesce(first.ok, false) AS is_correct,
  CASE WHEN first.ok IS NULL OR selected_label = 'E' THEN '—' ELSE {_CHOSEN.replace('question_id', 'first.question_id').replace(', question)', ', q.question)')} END AS chosen_text,
  CASE WHEN NOT coalesce(first.ok, false) THEN {_text('q.right_no').replace('question_id', 'q.question_id').replace(', question)', ', q.question)')} END AS correct_text,
  CASE WHEN first.ok IS NULL THEN NULL WHEN selected_label = 'E' THEN 'Could not evaluate answer.' WHEN first.ok THEN concat('Correct! ', q.explanation)
       ELSE concat('Incorrect. The correct answer was: "', {_text('q.right_no').replace('question_id', 'q.question_id').replace(', question)', ', q.question)')}, '"', chr(10), chr(10), q.explanation) END AS feedback
FROM lineitem li JOIN q ON q.question_id = li.l_partkey JOIN num ON num.session_id = li.l_orderkey
LEFT JOIN first ON first.session_id = li.l_orderkey AND first.question_id = li.l_partkey
LEFT JOIN tot ON tot.session_id = li.l_orderkey""")
def r11_history(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    asked = D.spread(lines, "l_orderkey").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("question_id"),
        F.concat_ws("-", "l_linenumber", "l_suppkey").alias("question_nth"),
    )
    answers = D.answers(spark, sf_dir).withColumn("nth", F.struct("pos", "tie_1", "tie_2"))
    return report.history(D.sessions(spark, sf_dir), asked, answers, D.questions_with_options(spark, sf_dir))


@query("r12_team_compare", f"""
WITH r AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS owner, n_nationkey, CAST(c_custkey % 101 AS INT) AS score, c_mktsegment AS category
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
cat AS (SELECT n_nationkey, category, CAST(floor(avg(score) + 0.5) AS INT) AS score FROM r GROUP BY n_nationkey, category),
o AS (SELECT n_nationkey, owner, CAST(floor(avg(score) + 0.5) AS INT) AS overall_score, count(*) AS session_count FROM r GROUP BY n_nationkey, owner)
SELECT CASE WHEN owner = '' THEN 'Teammate' ELSE owner END AS name, overall_score, session_count,
       {_band('overall_score', K.REPORT_BANDS)} AS overall_band, category, score FROM o JOIN cat USING (n_nationkey)""")
def r12_team_compare(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").join(D.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        "n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("exported_by"),
        (F.col("c_custkey") % 101).cast("int").alias("score"), F.col("c_mktsegment").alias("category"),
    )
    mean = F.floor(F.avg("score") + 0.5).cast("int")
    by_category = rows.groupBy("n_nationkey", "category").agg(mean.alias("score")).groupBy("n_nationkey").agg(
        F.collect_list(F.struct("category", "score")).alias("category_scores")
    )
    overall = rows.groupBy("n_nationkey", "exported_by").agg(mean.alias("overall_score"), F.count("*").alias("session_count"))
    return report.team_compare(overall.join(by_category, "n_nationkey"))


@query("r13_file_audit_lookup", f"""WITH {FILE_SCORES}, n AS (SELECT file, max(ts) AS last_updated FROM f GROUP BY file),
k AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat('/ws/', p_brand) END AS path, p_brand AS file FROM part)
SELECT path, CASE WHEN score IS NULL THEN 'Not audited yet | Click to audit' WHEN score >= 80 THEN concat(score, '% understood')
  ELSE concat(score, '% understood | Re-audit') END AS title, score, question_count, risk_level,
  CASE WHEN days IS NULL THEN NULL WHEN days = 0 THEN 'today' WHEN days > 1 THEN concat(days, ' days ago') ELSE concat(days, ' day ago') END AS last_audited
FROM k LEFT JOIN (SELECT fs.*, CAST(floor((epoch(TIMESTAMP '2002-01-01') - epoch(last_updated)) / 86400) AS BIGINT) AS days FROM fs JOIN n USING (file)) y USING (file)""")
def r13_file_audit_lookup(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    newest = facts.groupBy("file").agg(F.max("ts").cast("timestamp").alias("last_updated"))
    scores = scoring.file_scores(facts, D.critical_paths(spark, sf_dir)).join(newest, "file")
    scores = scores.withColumn("relative_path", F.col("file")).withColumn("file", F.concat(F.lit("/ws/"), "file"))
    part = D.table(spark, sf_dir, "part")
    paths = part.select(
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("/ws/"), "p_brand")).alias("path")
    ).distinct()
    return report.audit_lookup(paths, scores, F.lit("2002-01-01").cast("timestamp"))


@query("r14_zone_messages", f"""WITH {ZONES}
SELECT file, concat('0-0 You scored ', understanding_score, '% on understanding this ', category, ' code. Risk level: ', risk_level, '/10.') AS messages FROM z""")
def r14_zone_messages(spark, sf_dir):
    rows = report.zone_messages(_zones(spark, sf_dir))
    text = F.transform(
        "messages", lambda m: F.concat(m["start_line"].cast("string"), F.lit("-"), m["end_line"].cast("string"), F.lit(" "), m["message"])
    )
    return rows.select("file", F.array_join(text, "\n").alias("messages"))


@query("r15_score_report", f"""WITH {ZONES}
SELECT 'overall' AS part, 'all' AS key, CAST({_OVERALL} AS DOUBLE) AS value FROM fs
UNION ALL SELECT 'file', file, score FROM fs
UNION ALL SELECT 'category', category, {_pct(RIGHT, 'count(*)')} FROM f GROUP BY category
UNION ALL SELECT 'danger', relative_path, round(danger_score, 6) FROM z""")
def r15_score_report(spark, sf_dir):
    rep = jobs.score_report(
        D.answers(spark, sf_dir), D.questions(spark, sf_dir), D.sessions(spark, sf_dir),
        D.critical_paths(spark, sf_dir), grading.session_scores(D.answers(spark, sf_dir)),
    )
    return jobs.one_table_report(rep).withColumn("value", F.round("value", 6))


@query("r16_quiz_summary", f"""WITH {SESSION_SCORES}
SELECT session_id, correct, answered AS total, score, {_band('score', K.QUIZ_BANDS)} AS band, concat(correct, ' of ', answered, ' questions correct') AS label FROM ss""")
def r16_quiz_summary(spark, sf_dir):
    return report.quiz_summary(D.answers(spark, sf_dir))
