"""Text around an external model: code chunks, prompt texts, and parsing of its replies.

Only the tables before and after such a model are built here; nothing is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import let, split_lines
from graspmeter.prompt_texts import ANSWER_PROMPT, LEARNING_PROMPT, QUESTION_PROMPT


def chunk_code(files: DataFrame, max_lines: int = K.CHUNK_LINES) -> DataFrame:
    """Blocks of at most ``max_lines`` lines with 1-based first and last line."""

    def blocks(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(max_lines))
        return F.transform(
            starts,
            lambda s: F.struct(
                (s + 1).alias("start_line"),
                F.least(s + max_lines, F.size(lines)).alias("end_line"),
                F.array_join(F.slice(lines, s + 1, F.lit(max_lines)), "\n").alias("content"),
            ),
        )

    return files.select("file_id", F.posexplode(let(split_lines(F.col("content")), blocks)).alias("chunk_no", "c")).select(
        "file_id", "chunk_no", "c.*"
    )


def code_with_context(content: Column, start_line: Column, end_line: Column, context: int = K.CONTEXT_LINES) -> Column:
    """Lines ``start_line - context .. end_line + context`` (1-based, inclusive), within the text."""
    first = F.greatest(F.lit(0), start_line - 1 - context)

    def cut(lines: Column) -> Column:
        last = F.least(F.size(lines), end_line + context)
        return F.array_join(F.slice(lines, first + 1, F.greatest(last - first, F.lit(0))), "\n")

    return let(split_lines(content), cut)


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Fill ``<<name>>`` places; the texts themselves contain braces."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace(">>", "<<").split("<<")):
        if i % 2:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def question_prompts(files: DataFrame, count: int, difficulty: int, lines: int = K.PROMPT_LINES) -> DataFrame:
    """Prompt text per risky file: its lines from ``start_line`` on, at most ``lines`` of them.

    ``files(file_id, relative_path, category, language, framework, content, start_line)``.
    """
    start = F.col("start_line")

    # Line 0 means "from the first line"; as an index it is one before it, so that
    # block has one line less, as in the results to match.
    def cut(all_lines: Column) -> Column:
        end = F.least(start + lines - 1, F.size(all_lines))
        return F.when(start > 0, F.array_join(F.slice(all_lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise(
            F.when(end >= F.size(all_lines), F.get(all_lines, F.size(all_lines) - 1)).otherwise(F.lit(""))
        )

    block = let(split_lines(F.col("content")), cut)
    rows = files.withColumn("code_block", block)
    last = start + F.size(split_lines(F.col("code_block"))) - 1
    values = {
        "framework": F.coalesce("framework", F.lit("unknown")),
        "language": F.col("language"),
        "category": F.col("category"),
        "path": F.col("relative_path"),
        "start": start,
        "end": last,
        "start_5": start + 5,
        "code": F.col("code_block"),
        "count": F.lit(count),
        "difficulty": F.lit(difficulty),
    }
    return rows.select("file_id", "relative_path", _fill(QUESTION_PROMPT, values).alias("prompt"))


def answer_prompts(answers: DataFrame) -> DataFrame:
    """Prompt text per answer: question, code, both options and the result."""
    ok = F.col("is_correct")
    has_code = F.coalesce("code", F.lit("")) != ""
    code = F.when(
        has_code,
        F.concat(F.lit("\nRelevant code:\n```"), F.col("language"), F.lit("\n"), F.col("code"), F.lit("\n```")),
    )
    values = {
        "question": F.col("question"),
        "code": code,
        "user_answer": F.col("user_answer"),
        "correct_answer": F.col("correct_answer"),
        "result": F.when(ok, "CORRECT").otherwise("INCORRECT"),
        "focus": F.when(ok, "why their answer is correct and what to watch out for").otherwise(
            "what the correct behavior is and why their answer was wrong"
        ),
        "depths": F.when(ok, 'moderate" | "deep').otherwise('surface" | "moderate'),
        "gap": F.when(ok, "null").otherwise('"The specific concept they misunderstood"'),
    }
    return answers.select("answer_id", _fill(ANSWER_PROMPT, values).alias("prompt"))


def learning_prompts(zones: DataFrame, by: str) -> DataFrame:
    """Prompt text per project from its danger zones (bounded by the files of a project)."""
    line = F.format_string(
        "%s (%s): risk %d/10, %d%% understood", "relative_path", "category", "risk_level", "understanding_score"
    )
    listed = zones.groupBy(by).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("danger_score")).alias("o"), line.alias("line")))),
                lambda x: x["line"],
            ),
            "\n",
        ).alias("summary")
    )
    return listed.select(by, _fill(LEARNING_PROMPT, {"zones": F.col("summary")}).alias("prompt"))


# --- replies -----------------------------------------------------------------------------------

_QUESTIONS = (
    "struct<questions: array<struct<id: string, question: string, difficulty: int, category: string, "
    "codeReference: struct<file: string, startLine: int, endLine: int>, "
    "options: array<struct<label: string, text: string, isCorrect: boolean>>, "
    "explanation: string, dangerNote: string>>>"
)
_EVALUATION = "struct<understandingDepth: string, feedback: string, conceptGap: string>"


def strip_fences(text: Column) -> Column:
    """Text without the first code fence at a line start and the first one at a line end."""
    opened = F.regexp_replace(text, r"(?m)\A((?s:.*?))^```(?:json)?\s*", "$1")
    closed = F.regexp_replace(opened, r"(?m)\A((?s:.*?))\s*```\s*$", "$1")
    return F.regexp_replace(closed, r"\A\s+|\s+\z", "")


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies with the fences stripped and whether the rest is valid JSON."""
    clean = replies.withColumn("json", strip_fences(F.col("reply")))
    return clean.withColumn("is_json", F.try_parse_json("json").isNotNull())


def parse_questions(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split replies into question rows and rejected replies.

    A reply is rejected as a whole if it is no JSON, has no list of questions, or one of
    them lacks id, question or options or has not exactly one right option.
    """
    parsed = parse_replies(replies).withColumn("doc", F.from_json("json", _QUESTIONS))

    def bad(q: Column) -> Column:
        return (
            (F.coalesce(q["id"], F.lit("")) == "")
            | (F.coalesce(q["question"], F.lit("")) == "")
            | q["options"].isNull()
            | (F.size(F.filter(q["options"], lambda o: F.coalesce(o["isCorrect"], F.lit(False)))) != 1)
        )

    reason = (
        F.when(~F.col("is_json"), "not valid JSON")
        .when(F.col("doc.questions").isNull(), 'missing "questions" list')
        .when(F.exists("doc.questions", bad), "invalid question")
    )
    checked = parsed.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).select(
        "reply_id", F.posexplode("doc.questions").alias("pos", "q")
    )
    return (
        good.select("reply_id", "pos", "q.*"),
        checked.where(F.col("reason").isNotNull()).select("reply_id", "reason"),
    )


def parse_evaluations(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split replies into evaluations and rejected replies (no JSON, or no feedback)."""
    parsed = parse_replies(replies).withColumn("doc", F.from_json("json", _EVALUATION))
    ok = F.col("is_json") & (F.coalesce("doc.feedback", F.lit("")) != "")
    good = parsed.where(ok).select(
        "reply_id",
        F.lit(False).alias("is_correct"),
        F.coalesce("doc.understandingDepth", F.lit("surface")).alias("understanding_depth"),
        F.col("doc.feedback").alias("feedback"),
        F.col("doc.conceptGap").alias("concept_gap"),
    )
    reason = F.when(~F.col("is_json"), "not valid JSON").otherwise('missing "feedback"')
    return good, parsed.where(~ok).select("reply_id", reason.alias("reason"))
