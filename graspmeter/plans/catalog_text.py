"""Queries on text around a model and on answer streams (groups L and T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graspmeter.operators import chunks, grading
from graspmeter.plans import catalog_scores as scores
from graspmeter.plans import driver_tables as D
from graspmeter.streaming import answers as stream
from graspmeter.streaming import levels

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Blocks of ten lines: the texts at hand are short.
@query("l1_chunk_code", """
WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, lines, unnest(range(0, len(lines), 10)) AS first FROM h)
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(first / 10 AS INT) AS chunk_no, CAST(first + 1 AS INT) AS start_line,
       CAST(least(first + 10, len(lines)) AS INT) AS end_line, array_to_string(lines[first + 1 : first + 10], chr(10)) AS content FROM b""")
def l1_chunk_code(spark, sf_dir):
    return chunks.chunk_code(D.documents(spark, sf_dir), 10)


@query("l2_code_context", """
WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS lines, CAST(1 + doc_id % 20 AS INT) AS a FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS file_id,
       coalesce(array_to_string(lines[greatest(0, a - 6) + 1 : least(len(lines), a + 8)], chr(10)), '') AS code FROM h""")
def l2_code_context(spark, sf_dir):
    start = (1 + F.col("file_id").cast("bigint") % 20).cast("int")
    return D.documents(spark, sf_dir).select(
        "file_id", chunks.code_with_context(F.col("content"), start, start + 3).alias("code")
    )


def _sql_text(template: str, values: dict[str, str]) -> str:
    parts = []
    for i, piece in enumerate(template.replace(">>", "<<").split("<<")):
        if i % 2:
            parts.append(values[piece])
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})"


_BLOCK = "array_to_string(lines[a : least(a + 149, len(lines))], chr(10))"


@query("l3_question_prompts", "WITH h AS (SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS lines, CAST(1 + doc_id % 3 AS INT) AS a FROM documents), "
       f"b AS (SELECT *, coalesce({_BLOCK}, '') AS code FROM h) SELECT CAST(doc_id AS VARCHAR) AS file_id, "
       + _sql_text(chunks.QUESTION_PROMPT, {
           "framework": "'unknown'", "language": "'typescript'", "category": "lang", "path": "concat(source, '/', doc_id, '.ts')",
           "start": "a", "end": "a + len(string_split(code, chr(10))) - 1", "start_5": "a + 5", "code": "code", "count": "5", "difficulty": "3",
       }) + " AS prompt FROM b")
def l3_question_prompts(spark, sf_dir):
    docs = D.documents(spark, sf_dir, "lang").withColumnRenamed("lang", "category")
    files = docs.withColumn("framework", F.lit(None).cast("string")).withColumn(
        "start_line", (1 + F.col("file_id").cast("bigint") % 3).cast("int")
    )
    return chunks.question_prompts(files, 5, 3).select("file_id", "prompt")


_ANSWER_ID = "concat_ws('-', session_id, pos, question_id, tie_1, tie_2)"


@query("l4_eval_and_path_prompts", f"WITH {scores._GRADED} SELECT concat_ws('-', session_id, pos, question_id, tie_1) AS answer_id, "
       + _sql_text(chunks.ANSWER_PROMPT, {
           "question": "question", "code": "''", "user_answer": f"CASE WHEN selected_label = 'E' THEN '' ELSE {scores._CHOSEN} END",
           "correct_answer": scores._text("right_no"), "result": "CASE WHEN ok THEN 'CORRECT' ELSE 'INCORRECT' END",
           "focus": "CASE WHEN ok THEN 'why their answer is correct and what to watch out for' ELSE 'what the correct behavior is and why their answer was wrong' END",
           "depths": "CASE WHEN ok THEN 'moderate\" | \"deep' ELSE 'surface\" | \"moderate' END",
           "gap": "CASE WHEN ok THEN 'null' ELSE '\"The specific concept they misunderstood\"' END",
       }) + " AS prompt FROM j")
def l4_eval_and_path_prompts(spark, sf_dir):
    key = grading.answer_key(D.questions_with_options(spark, sf_dir))
    rows = D.answers(spark, sf_dir).join(key.select("question_id", "question", "texts", "right_label", "right_text").hint("merge"), "question_id")
    return chunks.answer_prompts(
        rows.select(
            F.concat_ws("-", "session_id", "pos", "question_id", "tie_1").alias("answer_id"),
            "question", (F.col("selected_label") == F.col("right_label")).alias("is_correct"), F.lit("").alias("code"),
            F.lit("typescript").alias("language"), grading.chosen_text().alias("user_answer"),
            F.col("right_text").alias("correct_answer"),
        )
    )


@query("l4_learning_prompts", f"WITH {scores.ZONES}, g AS (SELECT category, string_agg(concat(relative_path, ' (', category, '): risk ', risk_level, '/10, ', "
       "understanding_score, '% understood'), chr(10) ORDER BY danger_score DESC, relative_path) AS summary FROM z GROUP BY category) SELECT category, "
       + _sql_text(chunks.LEARNING_PROMPT, {"zones": "summary"}) + " AS prompt FROM g")
def l4_learning_prompts(spark, sf_dir):
    return chunks.learning_prompts(scores._zones(spark, sf_dir), "category")


# Replies of a model: the assistant turns, wrapped into the JSON that was asked for. Every
# fifth is broken, every seventh has two right options.
def _replies(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)
    n = F.col("conv_id") + F.col("turn")
    two = F.when(n % 7 == 0, "true").otherwise("false")
    body = F.concat(
        F.lit('{"questions": [{"id": "q'), "conv_id", F.lit('", "question": '), quoted,
        F.lit(', "options": [{"label": "A", "text": "x", "isCorrect": true}, {"label": "B", "text": "y", "isCorrect": '), two,
        F.lit("}]}]"), F.when(n % 5 == 0, "").otherwise("}"),
    )
    evaluation = F.concat(
        F.lit('{"feedback": '), F.when(n % 5 == 0, '""').otherwise(quoted),
        F.when(n % 2 == 0, ', "understandingDepth": "deep"').otherwise(""), F.lit("}"),
    )
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("reply_id"),
        F.concat(F.lit("```json\n"), body, F.lit("\n```\n")).alias("questions_reply"),
        F.concat(F.lit("```\n"), evaluation, F.lit("\n```")).alias("evaluation_reply"),
    )


_TURNS = "t AS (SELECT concat_ws('-', conv_id, turn) AS reply_id, conv_id, conv_id + turn AS n, text FROM conversations WHERE role = 'assistant')"


@query("l5_parse_replies", f"WITH {_TURNS} SELECT reply_id, n % 5 <> 0 AS is_json, NULLIF(n % 5 <> 0, false) AND true AS has_questions FROM t".replace(
    "NULLIF(n % 5 <> 0, false) AND true", "n % 5 <> 0"))
def l5_parse_replies(spark, sf_dir):
    replies = _replies(spark, sf_dir).select("reply_id", F.col("questions_reply").alias("reply"))
    return chunks.parse_replies(replies).select(
        "reply_id", "is_json", (F.col("is_json") & F.get_json_object("json", "$.questions").isNotNull()).alias("has_questions")
    )


@query("l6_validate_questions", f"""WITH {_TURNS}
SELECT reply_id, CASE WHEN n % 5 = 0 THEN 'not valid JSON' WHEN n % 7 = 0 OR text = '' THEN 'invalid question' ELSE '' END AS reason,
       CASE WHEN n % 5 <> 0 AND n % 7 <> 0 AND text <> '' THEN concat('q', conv_id) END AS id,
       CASE WHEN n % 5 <> 0 AND n % 7 <> 0 AND text <> '' THEN text END AS question FROM t""")
def l6_validate_questions(spark, sf_dir):
    replies = _replies(spark, sf_dir).select("reply_id", F.col("questions_reply").alias("reply"))
    good, rejected = chunks.parse_questions(replies)
    none = F.lit(None).cast("string")
    return good.select("reply_id", F.lit("").alias("reason"), "id", "question").unionByName(
        rejected.select("reply_id", "reason", none.alias("id"), none.alias("question"))
    )


@query("l7_parse_evaluation", f"""WITH {_TURNS}
SELECT reply_id, CASE WHEN n % 5 = 0 OR text = '' THEN 'missing "feedback"' ELSE '' END AS reason,
       CASE WHEN n % 5 <> 0 AND text <> '' THEN CASE WHEN n % 2 = 0 THEN 'deep' ELSE 'surface' END END AS understanding_depth,
       CASE WHEN n % 5 <> 0 AND text <> '' THEN text END AS feedback FROM t""")
def l7_parse_evaluation(spark, sf_dir):
    replies = _replies(spark, sf_dir).select("reply_id", F.col("evaluation_reply").alias("reply"))
    good, rejected = chunks.parse_evaluations(replies)
    none = F.lit(None).cast("string")
    return good.select("reply_id", F.lit("").alias("reason"), "understanding_depth", "feedback").unionByName(
        rejected.select("reply_id", "reason", none.alias("understanding_depth"), none.alias("feedback"))
    )


# --- streams --------------------------------------------------------------------------------

_E = "e AS (SELECT event_id AS answer_id, user_id, ts, event_type <> 'error' AS is_correct FROM events)"
_RIGHT = "count(*) FILTER (WHERE is_correct)"


# A last file brings the fifty oldest answers again under new ids: the watermark is past them.
@query("t1_running_scores", f"""WITH {_E} SELECT user_id, {_RIGHT} AS correct, count(*) AS answered, {scores._pct(_RIGHT, 'count(*)')} AS score,
       (SELECT least(50, count(*)) FROM e) AS dropped_late FROM e GROUP BY user_id""")
def t1_running_scores(spark, sf_dir):
    result = stream.running_scores(D.period_answers(spark, sf_dir, 5, late=50), "1 day")
    _, folder = stream.write_table(result, "update")
    return stream.latest(spark, folder, ["user_id"]).withColumn("dropped_late", F.lit(stream.dropped_late(spark, folder)).cast("bigint"))


@query("t2_adaptive_stream", f"WITH {_E}, " + scores._adaptive_sql("user_id", "e", "ts, answer_id", "3").replace(
    "SELECT key AS user_id", "SELECT key AS user_id, CAST(0 AS BIGINT) AS late"))
def t2_adaptive_stream(spark, sf_dir):
    """Levels in the state store, over six micro-batches."""
    states = levels.adaptive_states(D.period_answers(spark, sf_dir, 6))
    _, folder = stream.write_table(states, "update")
    return levels.levels_of(stream.latest(spark, folder, ["user_id"])).drop("expired")


@query("t3_daily_scores", f"""WITH {_E} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {_RIGHT} AS correct, count(*) AS answered,
       {scores._pct(_RIGHT, 'count(*)')} AS score FROM e GROUP BY date_trunc('day', ts)""")
def t3_daily_scores(spark, sf_dir):
    result = stream.windowed_scores(D.stream_answers(spark, sf_dir), "30 days", "1 day")
    _, folder = stream.write_table(result, "update")
    rows = stream.latest(spark, folder, ["window_start", "window_end"])
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "correct", "answered", "score")


@query("t3_sliding_scores", f"""WITH {_E}, w AS (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * d AS start, is_correct FROM e CROSS JOIN (VALUES (0), (1)) v(d))
SELECT strftime(start, '%Y-%m-%d') AS window_start, {_RIGHT} AS correct, count(*) AS answered FROM w GROUP BY start""")
def t3_sliding_scores(spark, sf_dir):
    result = stream.windowed_scores(D.stream_answers(spark, sf_dir), "30 days", "2 days", "1 day")
    _, folder = stream.write_table(result, "update")
    rows = stream.latest(spark, folder, ["window_start", "window_end"])
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "correct", "answered")


# The last session of a user may still be open when the stream ends: only closed ones count.
@query("t3_gap_sessions", f"""WITH {_E},
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, answer_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, answer_id) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, {_RIGHT} AS correct, count(*) AS answered FROM k GROUP BY user_id, no
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)""")
def t3_gap_sessions(spark, sf_dir):
    result = stream.gap_sessions(D.stream_answers(spark, sf_dir), "10 minutes", "2 hours")
    _, folder = stream.write_table(result, "append")
    rows = spark.read.parquet(folder)
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "correct", "answered")
