"""Grading of answers and the difficulty that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.scores import n_right, percent

# Wrong beliefs, tested in this order on the lower-case text of the chosen option.
MISCONCEPTIONS = [
    (["express", "catch"], None, "Misconception: Express does NOT automatically catch async errors in route handlers. You need explicit try-catch or an async wrapper middleware."),
    (["typescript"], ["prevent", "type system"], "Misconception: TypeScript types are erased at runtime. Type annotations don't prevent null/undefined at runtime."),
    ([], ["automatically", "retries"], "Misconception: Most external API calls and database operations do NOT retry automatically."),
    (["global", "handler"], None, "Misconception: Global error handlers only catch errors that bubble up to them. Silent catches and unhandled Promise rejections may not reach the global handler."),
    ([], ["returns null", "returns undefined"], "Misconception: Functions don't automatically return safe values on error. Without explicit error handling, errors throw."),
    ([], ["gitignore"], "Misconception: .gitignore only prevents files from being tracked, but hardcoded secrets in already-tracked files are still visible in git history."),
]


def _place() -> Column:
    return F.concat(F.col("file"), F.lit(":"), (F.col("start_line") + 1).cast("string"))


def misconception(chosen: Column) -> Column:
    """Known wrong belief behind a wrong option, else a pointer to the code."""
    low = F.lower(chosen)

    def holds(every: list[str], some: list[str] | None) -> Column:
        cond = F.lit(True)
        for word in every:
            cond = cond & low.contains(word)
        if some:
            either = F.lit(False)
            for word in some:
                either = either | low.contains(word)
            cond = cond & either
        return cond

    picks = [F.when(holds(every, some), F.lit(text)) for every, some, text in MISCONCEPTIONS]
    default = F.concat(F.lit("Review the code at "), _place(), F.lit(" to understand the actual behavior."))
    return F.coalesce(*picks, default)


def answer_key(questions: DataFrame) -> DataFrame:
    """Questions with the texts of their options by label, the right label and its text.

    Worked out once per question, so that an answer only needs a lookup. Of two options with
    the same label the first counts.
    """
    labels = F.transform("options", lambda o: o["label"])
    first = F.filter("options", lambda o, i: F.array_position(labels, o["label"]) == i + 1)
    right = F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))
    return questions.withColumns(
        {
            "texts": F.map_from_entries(F.transform(first, lambda o: F.struct(o["label"], o["text"]))),
            "right_label": right["label"],
            "right_text": right["text"],
        }
    ).drop("options")


def chosen_text() -> Column:
    return F.try_element_at("texts", F.col("selected_label"))


def graded_columns(detailed: bool = False) -> dict[str, Column]:
    """Columns of a graded answer, for rows of answers joined with ``answer_key``.

    A label that is no option, or a question without a right one, counts as wrong.
    """
    chosen, right = F.try_element_at("texts", F.col("selected_label")), F.col("right_text")
    usable = F.col("right_label").isNotNull() & chosen.isNotNull()
    ok = usable & (F.col("right_label") == F.col("selected_label"))
    praise = F.concat(F.lit("Correct! "), F.col("explanation"))
    if detailed:
        depth = (
            F.when(F.col("difficulty") >= 4, "deep").when(F.col("difficulty") >= 2, "moderate").otherwise("surface")
        )
        blame = F.concat(
            F.lit('Incorrect. You selected: "'), chosen,
            F.lit('"\n\nThe correct answer is: "'), right,
            F.lit('"\n\n'), F.col("explanation"),
        )
        unusable = "Unable to evaluate answer: question options are malformed."
        gap = misconception(chosen)
    else:
        depth = F.lit("moderate")
        blame = F.concat(
            F.lit('Incorrect. The correct answer was: "'), right, F.lit('"\n\n'), F.col("explanation")
        )
        unusable = "Could not evaluate answer."
        gap = F.concat(F.lit("Review the code at "), _place())
    return {
        "is_correct": F.coalesce(ok, F.lit(False)),
        "understanding_depth": F.when(ok, depth).otherwise("surface"),
        "feedback": F.when(~usable, unusable).when(ok, praise).otherwise(blame),
        "concept_gap": F.when(usable & ~ok, gap),
    }


def grade(answers: DataFrame, questions: DataFrame, detailed: bool = False) -> DataFrame:
    """Compare the chosen label with the right one and explain.

    ``questions(question_id, options, explanation, difficulty, file, start_line)``.
    ``detailed`` takes the depth from the difficulty, quotes the chosen text and names the
    misconception. Both sides are dealt out by question: option texts take many times the size
    that Spark goes by, so a bank of a million questions must not be broadcast through the driver.
    """
    key = answer_key(
        questions.select("question_id", "options", "explanation", "difficulty", "file", "start_line")
    )
    kept = [c for c in answers.columns if c != "is_correct"]
    columns = graded_columns(detailed)
    return answers.join(key.hint("merge"), "question_id").select(*kept, *[c.alias(n) for n, c in columns.items()])


def session_scores(answers: DataFrame) -> DataFrame:
    """Score, right and answered per session."""
    return answers.groupBy("session_id").agg(
        percent(n_right(), F.count("*")).alias("score"),
        n_right().alias("correct"),
        F.count("*").alias("answered"),
    )


# --- adaptive difficulty ---------------------------------------------------------------------
#
# The level (1..5) moves with streaks: three right in a row up, two wrong in a row down, and a
# move starts the count again. Level and streak together have 20 values, so what a run of
# answers does is a table of 20 entries, and tables of consecutive runs compose. A hot key is
# cut into runs that are folded in parallel; only the 20-entry tables of a key meet.

# Answers of a run at most.
RUN_ROWS = 10_000
_STREAKS = [(0, 0), (1, 0), (2, 0), (0, 1)]
_LEVELS = K.MAX_LEVEL - K.MIN_LEVEL + 1


def _state(level: int, streak: tuple[int, int]) -> int:
    return (level - K.MIN_LEVEL) * len(_STREAKS) + _STREAKS.index(streak)


def next_state(state: int, is_correct: bool) -> int:
    """State after one answer; a state is a level and a streak as one number."""
    level, streak = state // len(_STREAKS) + K.MIN_LEVEL, _STREAKS[state % len(_STREAKS)]
    right, wrong = (streak[0] + 1, 0) if is_correct else (0, streak[1] + 1)
    if right >= K.RIGHT_STREAK:
        return _state(min(K.MAX_LEVEL, level + 1), (0, 0))
    if wrong >= K.WRONG_STREAK:
        return _state(max(K.MIN_LEVEL, level - 1), (0, 0))
    return _state(level, (right, wrong))


def _table(is_correct: bool) -> Column:
    n = _LEVELS * len(_STREAKS)
    return F.array(*[F.lit(next_state(s, is_correct)) for s in range(n)])


def start_level(override: Column | int | None = None) -> Column:
    """Level a session starts with: 3, or a chosen one kept within 1 and 5."""
    if override is None:
        return F.lit(K.START_LEVEL)
    chosen = F.lit(override) if isinstance(override, int) else override
    return F.when(chosen > 0, F.greatest(F.lit(K.MIN_LEVEL), F.least(F.lit(K.MAX_LEVEL), chosen))).otherwise(
        K.START_LEVEL
    )


def run_tables(
    answers: DataFrame, key: str, order: list[str], partitions: int | None = None
) -> DataFrame:
    """Per key: number of answers and the tables of its runs, in order.

    Rows are range-partitioned by key and order, and what a partition holds of a key is cut into
    runs of at most ``RUN_ROWS`` answers, so no array grows with the data.
    """
    n = partitions or int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = answers.select(key, *order, "is_correct").repartitionByRange(n, key, *order)
    in_part = Window.partitionBy(key, "part").orderBy(*order)
    runs = (
        ranged.withColumn("part", F.spark_partition_id())
        .withColumn("run", F.floor((F.row_number().over(in_part) - 1) / RUN_ROWS))
        .groupBy(key, "part", "run")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "is_correct"))).alias("steps"))
    )
    states = F.sequence(F.lit(0), F.lit(_LEVELS * len(_STREAKS) - 1))
    up, down = _table(True), _table(False)
    table = F.aggregate(
        "steps",
        states,
        lambda acc, a: F.transform(
            acc, lambda s: F.when(a["is_correct"], F.get(up, s)).otherwise(F.get(down, s))
        ),
    )
    return (
        runs.select(key, "part", "run", F.size("steps").cast("bigint").alias("n"), table.alias("table"))
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("part", "run", "table"))).alias("tables"),
            F.sum("n").alias("answered"),
        )
    )


def state_of(level: Column) -> Column:
    """State of a key that has answered nothing since it was given this level."""
    return ((level - K.MIN_LEVEL) * len(_STREAKS)).cast("int")


def apply_tables(tables: Column, state: Column) -> Column:
    return F.aggregate(tables, state, lambda s, t: F.get(t["table"], s))


def level_of(state: Column) -> Column:
    return (F.floor(state / len(_STREAKS)) + K.MIN_LEVEL).cast("int")


def adaptive_difficulty(
    answers: DataFrame,
    key: str,
    order: list[str],
    start: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Level and streaks per key after all its answers, taken in ``order``.

    ``start`` is the first level, a function of the key only.
    """
    first = start if start is not None else F.lit(K.START_LEVEL)
    final = run_tables(answers, key, order, partitions).withColumn(
        "state", apply_tables(F.col("tables"), state_of(first))
    )
    streak = F.col("state") % len(_STREAKS)
    return final.select(
        key,
        "answered",
        level_of(F.col("state")).alias("level"),
        F.when(streak < 3, streak).otherwise(0).alias("right_streak"),
        F.when(streak == 3, 1).otherwise(0).alias("wrong_streak"),
    )


def record_answers(log: DataFrame, graded: DataFrame) -> DataFrame:
    """The answer log with new graded answers appended."""
    return log.unionByName(graded.select(*log.columns))
