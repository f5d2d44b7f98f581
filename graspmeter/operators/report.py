"""Report tables: progress, learning path, history, team comparison, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.scores import band, n_right, percent
from graspmeter.operators.grading import answer_key, graded_columns
from graspmeter.operators.pools import fresh_pools
from graspmeter.session import materialize


def progress_timeline(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Finished sessions with end time and score (0 if nothing was answered), in no order."""
    done = sessions.where(F.col("end_ts").isNotNull())
    return (
        done.join(scores.select("session_id", "score"), "session_id", "left")
        .select("user_id", "session_id", "end_ts", F.coalesce("score", F.lit(0)).alias("score"))
    )


def trend(timeline: DataFrame) -> DataFrame:
    """Per user: improving or declining by 10 points over the last three sessions, else stable.

    ``row_number <= 3`` is cut on the map side, so a user with very many sessions is cheap.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("end_ts"), F.desc("session_id"))
    last = timeline.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= 3)
    moved = F.col("last_score") - F.col("first_score")
    return (
        last.groupBy("user_id")
        .agg(
            F.max_by("score", "rn").alias("first_score"),
            F.min_by("score", "rn").alias("last_score"),
            F.count("*").alias("n_recent"),
        )
        .withColumn(
            "trend",
            F.when(F.col("n_recent") < 2, "stable")
            .when(moved >= K.TREND_STEP, "improving")
            .when(moved <= -K.TREND_STEP, "declining")
            .otherwise("stable"),
        )
    )


def learning_path(
    wrong: DataFrame, questions: DataFrame, zones: DataFrame, scores: DataFrame, order: list[Column]
) -> DataFrame:
    """Up to ten things to study: latest wrong answers, then danger zones, else the lowest files.

    ``wrong(question_id, selected_label, file, start_line)`` and ``order``, which puts the
    newest answer first. Only ids go through the shuffle; texts are added to the rows that
    are kept. Every branch is cut to its first rows before the branches meet.
    """
    item = ["branch", "rank", "file", "start_line", "end_line", "concept", "why_it_matters", "key"]
    place = F.concat_ws(":", "file", F.col("start_line").cast("string"))
    newest = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    first_wrong = (
        wrong.select(place.alias("key"), newest.alias("o"), "question_id", "selected_label")
        .groupBy("key")
        .agg(F.min_by(F.struct("question_id", "selected_label"), "o").alias("x"), F.min("o").alias("o"))
        .orderBy("o")
        .limit(K.LEARNING_ITEMS)
    )
    ranked = first_wrong.select("key", "x.*", F.row_number().over(Window.orderBy("o")).alias("rank"))
    concept = F.concat(
        F.replace("category", F.lit("-"), F.lit(" ")), F.lit(" — "), F.substring("question", 1, 60), F.lit("…")
    )
    from_answers = answer_key(questions).join(ranked, "question_id").select(
        F.lit(0).alias("branch"), "rank", "file", "start_line", "end_line", concept.alias("concept"),
        graded_columns()["feedback"].alias("why_it_matters"), "key",
    )
    # Rows of one place are one item, so they come together before the first are taken.
    zone = F.struct((-F.col("danger_score")).alias("o"), "relative_path", "category", *[c for c in zones.columns if c not in ("danger_score", "relative_path", "category")])
    one_each = zones.groupBy("file", "start_line").agg(F.min(zone).alias("z")).select("z.*", (-F.col("z.o")).alias("danger_score"))
    top_zones = one_each.orderBy(F.desc("danger_score"), "relative_path", "file").limit(2 * K.LEARNING_ITEMS)
    from_zones = top_zones.select(
        F.lit(1).alias("branch"),
        F.row_number().over(Window.orderBy(F.desc("danger_score"), "relative_path")).alias("rank"),
        F.col("relative_path").alias("file"),
        "start_line",
        "end_line",
        F.col("category").alias("concept"),
        F.concat(
            F.lit("Risk level "), F.col("risk_level").cast("string"), F.lit("/5 — understanding score "),
            F.col("understanding_score").cast("string"), F.lit("%"),
        ).alias("why_it_matters"),
        F.concat_ws(":", F.col("file"), F.col("start_line").cast("string")).alias("key"),
    )
    lowest = scores.orderBy("score", "file").limit(K.LEARNING_FALLBACK)
    percent_text = F.concat(F.col("score").cast("string"), F.lit("% understood)"))
    from_scores = lowest.select(
        F.lit(2).alias("branch"),
        F.row_number().over(Window.orderBy("score", "file")).alias("rank"),
        F.col("relative_path").alias("file"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.concat(F.lit("Review: "), F.col("relative_path"), F.lit(" ("), percent_text).alias("concept"),
        F.when(F.col("score") >= 80, "Strong score but worth revisiting to maintain mastery.")
        .otherwise("Scored below 80% — review and retake quiz.")
        .alias("why_it_matters"),
        F.concat(F.lit("review:"), "relative_path").alias("key"),
    )
    # From here on there are at most a few dozen rows.
    few = from_answers.select(*item).unionByName(from_zones.select(*item)).unionByName(from_scores.select(*item))
    by_key = Window.partitionBy("key").orderBy("branch", "rank")
    everything = Window.partitionBy()
    kept = (
        few.withColumn("nth", F.row_number().over(by_key))
        .where(F.col("nth") == 1)
        .withColumn("main", F.count_if(F.col("branch") < 2).over(everything))
        .where((F.col("branch") < 2) | (F.col("main") == 0))
        .withColumn("priority", F.row_number().over(Window.orderBy("branch", "rank")))
        .where(F.col("priority") <= K.LEARNING_ITEMS)
    )
    return kept.select("priority", "file", "start_line", "end_line", "concept", "why_it_matters")


def learning_paths(
    wrong: DataFrame, questions: DataFrame, critical: DataFrame, user_scores: DataFrame, users: DataFrame, order: list[Column], n: int = K.LEARNING_ITEMS
) -> DataFrame:
    """The learning path of every user: ``user_id, priority, file, start_line, end_line, concept, why_it_matters``.

    As ``learning_path``, by user: the newest wrong answers by place, then danger zones by the
    user's own scores, and without either the user's files of the lowest scores. ``wrong`` and
    ``user_scores`` (``user_id, file, score``) have rows of users; ``critical`` is as for the
    zones, a row a file. A risky file that a user has no score of counts with 0, so nearly all
    risky files are zones of nearly all users: the first of them follow from the gaps between
    those that the user has a score of (``pools``), not from a product.
    """
    item = ["user_id", "branch", "rank", "file", "start_line", "end_line", "concept", "why_it_matters"]
    newest = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    places = wrong.groupBy("user_id", "file", "start_line").agg(F.min_by(F.struct("question_id", "selected_label"), newest).alias("x"), F.min(newest).alias("o"))
    first = places.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("o"))).where(F.col("rank") <= n)
    concept = F.concat(F.replace("category", F.lit("-"), F.lit(" ")), F.lit(" — "), F.substring("question", 1, 60), F.lit("…"))
    from_answers = answer_key(questions).hint("merge").join(first.select("user_id", "rank", "x.*"), "question_id").select(
        "user_id", F.lit(0).alias("branch"), "rank", "file", "start_line", "end_line", concept.alias("concept"),
        graded_columns()["feedback"].alias("why_it_matters"),
    )

    risky = critical.where(F.col("risk_level") >= K.DANGER_RISK).select("file", "category", "risk_level")
    known = user_scores.select("user_id", "file", "score").join(risky.select("file"), "file", "left_semi")
    by_risk = [F.desc("risk_level"), F.asc("question_id")]
    unknown = fresh_pools(risky.withColumnRenamed("file", "question_id"), known.select("user_id", F.col("file").alias("question_id")), users, n, by_risk)
    unknown = unknown.where("fresh").select("user_id", F.col("question_id").alias("file"), F.lit(0).alias("score"))
    zones = known.where(F.col("score") <= K.DANGER_SCORE).select("user_id", "file", "score").unionByName(unknown).join(risky, "file")
    danger = F.col("risk_level") * (1 - F.col("score") / 100)
    zones = zones.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(danger.desc(), "file"))).where(F.col("rank") <= n)
    risk = F.concat(F.lit("Risk level "), F.col("risk_level").cast("string"), F.lit("/5 — understanding score "), F.col("score").cast("string"), F.lit("%"))
    none = F.lit(0)
    from_zones = zones.select("user_id", F.lit(1).alias("branch"), "rank", "file", none.alias("start_line"), none.alias("end_line"), F.col("category").alias("concept"), risk.alias("why_it_matters"))

    main = materialize(from_answers.select(*item).unionByName(from_zones.select(*item)), "items")
    lowest = user_scores.join(users.select("user_id").distinct(), "user_id", "left_semi").join(main.select("user_id").distinct(), "user_id", "left_anti")
    lowest = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("score", "file"))).where(F.col("rank") <= K.LEARNING_FALLBACK)
    review = F.concat(F.lit("Review: "), F.col("file"), F.lit(" ("), F.col("score").cast("string"), F.lit("% understood)"))
    advice = F.when(F.col("score") >= 80, "Strong score but worth revisiting to maintain mastery.").otherwise("Scored below 80% — review and retake quiz.")
    one = F.lit(1)
    from_scores = lowest.select("user_id", F.lit(2).alias("branch"), "rank", "file", one.alias("start_line"), one.alias("end_line"), review.alias("concept"), advice.alias("why_it_matters"))
    priority = F.row_number().over(Window.partitionBy("user_id").orderBy("branch", "rank"))
    ordered = main.unionByName(from_scores.select(*item)).withColumn("priority", priority).where(F.col("priority") <= n)
    return ordered.select("user_id", "priority", *item[3:])


def score_bands(scores: DataFrame) -> DataFrame:
    """Score of each file in the three scales in use: report, file colour and quiz."""
    s = F.col("score")
    return scores.withColumns(
        {
            "report_band": band(s, K.REPORT_BANDS),
            "color": band(s, K.FILE_COLORS),
            "quiz_band": band(s, K.QUIZ_BANDS),
        }
    )


def lowest_files(scores: DataFrame, n: int = K.LOWEST_FILES) -> DataFrame:
    return scores.orderBy("score", "file").limit(n)


def session_numbers(sessions: DataFrame) -> DataFrame:
    """Number of each session of its user, oldest first.

    Ranked within the day and shifted by the sessions of earlier days: the rows of a user
    are never sorted in one task, only the user's day counts are.
    """
    dated = sessions.select("user_id", "session_id", "start_ts", F.to_date("start_ts").alias("day"))
    in_day = Window.partitionBy("user_id", "day").orderBy("start_ts", "session_id")
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        dated.groupBy("user_id", "day")
        .agg(F.count("*").alias("n"))
        .select("user_id", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        dated.withColumn("rn", F.row_number().over(in_day))
        .join(days, ["user_id", "day"])
        .select("user_id", "session_id", "start_ts", (F.col("before") + F.col("rn")).alias("session_no"))
    )


def history(
    sessions: DataFrame, session_questions: DataFrame, answers: DataFrame, questions: DataFrame
) -> DataFrame:
    """One row per question of every session, answered or not.

    Flat rows instead of one nested row per session, so a long session stays spread out.
    ``answers(session_id, question_id, nth, selected_label)``: the first answer to a question
    counts. Texts are added after the answers have been aggregated.
    """
    key = answer_key(questions.select("question_id", "question", "options", "explanation", "file", "start_line"))
    right = key.select("question_id", F.col("right_label").alias("_right"))
    marked = answers.join(right, "question_id").withColumn(
        "is_correct", F.coalesce(F.col("selected_label") == F.col("_right"), F.lit(False))
    )
    first = marked.groupBy("session_id", "question_id").agg(
        F.min_by("selected_label", "nth").alias("selected_label"), F.lit(True).alias("answered")
    )
    totals = marked.groupBy("session_id").agg(n_right().alias("n_right"), F.count("*").alias("n_answered"))
    # Session facts meet first, so the many rows are joined with them once.
    about_session = session_numbers(sessions).join(totals, "session_id", "left")
    graded = graded_columns()
    ok = F.col("answered").isNotNull() & graded["is_correct"]
    return (
        session_questions.join(first, ["session_id", "question_id"], "left")
        .join(about_session, "session_id")
        .join(key.hint("merge"), "question_id")
        .select(
            "user_id",
            "session_no",
            "session_id",
            F.coalesce("n_right", F.lit(0)).alias("n_right"),
            F.coalesce("n_answered", F.lit(0)).alias("n_answered"),
            "question_nth",
            "question",
            ok.alias("is_correct"),
            F.coalesce(F.try_element_at("texts", F.col("selected_label")), F.lit("—")).alias("chosen_text"),
            F.when(~ok, F.coalesce("right_text", F.lit("—"))).alias("correct_text"),
            F.when(F.col("answered"), graded["feedback"]).alias("feedback"),
        )
    )


def team_compare(exports: DataFrame) -> DataFrame:
    """Category rows of every export; ``Teammate`` if it has no name."""
    name = F.when(F.coalesce("exported_by", F.lit("")) == "", "Teammate").otherwise(F.col("exported_by"))
    return (
        exports.select(
            name.alias("name"), "overall_score", "session_count", F.explode_outer("category_scores").alias("c")
        )
        .select(
            "name",
            "overall_score",
            "session_count",
            band(F.col("overall_score"), K.REPORT_BANDS).alias("overall_band"),
            F.col("c.category").alias("category"),
            F.col("c.score").alias("score"),
        )
    )


def team_categories(exports: DataFrame, most: int = 50) -> list[str]:
    """The categories that occur, in order; more than ``most`` are an error, as each is two columns of the matrix."""
    found = exports.select(F.explode("category_scores.category").alias("c")).where("c is not null").distinct().orderBy("c").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories: name those that are wanted")
    return [row.c for row in found]


def team_matrix(exports: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """A row for each export with score and rank of every category as columns ``<category>_score`` and ``_rank``.

    ``exports`` has ``export_id, exported_by, overall_score, category_scores``. The best score of
    a category has rank 1, equal scores share a rank and the ranks behind them are left out. An
    export without a category has nulls there. A rank follows from the numbers of exports by
    category and score, a hundred rows a category, so no category is sorted as a whole.
    """
    wanted = team_categories(exports) if categories is None else categories
    name = F.when(F.coalesce("exported_by", F.lit("")) == "", "Teammate").otherwise(F.col("exported_by"))
    rows = exports.select("export_id", F.inline("category_scores")).where(F.col("category").isin(wanted) & F.col("score").isNotNull())
    rows = rows.groupBy("export_id", "category").agg(F.max("score").alias("score"))
    better = Window.partitionBy("category").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("category", "score").agg(F.count(F.lit(1)).alias("n"))
    ranks = counts.select("category", "score", (F.coalesce(F.sum("n").over(better), F.lit(0)) + 1).cast("int").alias("rank"))
    placed = rows.join(ranks, ["category", "score"]).groupBy("export_id").pivot("category", wanted)
    matrix = placed.agg(F.first("score").alias("score"), F.first("rank").alias("rank")) if wanted else rows.select("export_id").distinct()
    return exports.select("export_id", name.alias("name"), "overall_score").join(matrix, "export_id", "left")


def audit_lookup(paths: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """Score of each given path (absolute or relative), or that it was not audited yet.

    ``scores(file, relative_path, score, question_count, risk_level, last_updated)``. Both
    names of a score are keys of one equi-join; the file's own name wins.
    """
    names = F.array_distinct(F.array("file", "relative_path"))
    keyed = (
        scores.select(F.posexplode(names).alias("pos", "path"), "*")
        .groupBy("path")
        .agg(
            F.min_by(
                F.struct("score", "question_count", "risk_level", "last_updated"), F.struct("pos", "file")
            ).alias("s")
        )
    )
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("s.last_updated")) / 86400)
    ago = F.when(days == 0, "today").otherwise(
        F.concat(days.cast("string"), F.when(days > 1, " days ago").otherwise(" day ago"))
    )
    score = F.col("s.score").cast("string")
    title = F.when(F.col("s").isNull(), "Not audited yet | Click to audit").otherwise(
        F.concat(score, F.lit("% understood"), F.when(F.col("s.score") >= 80, "").otherwise(" | Re-audit"))
    )
    return paths.join(keyed, "path", "left").select(
        "path",
        title.alias("title"),
        F.col("s.score").alias("score"),
        F.col("s.question_count").alias("question_count"),
        F.col("s.risk_level").alias("risk_level"),
        F.when(F.col("s").isNotNull(), ago).alias("last_audited"),
    )


def zone_messages(zones: DataFrame) -> DataFrame:
    """Messages of the danger zones of each file with their line range."""
    text = F.format_string(
        "You scored %d%% on understanding this %s code. Risk level: %d/10.",
        "understanding_score", "category", "risk_level",
    )
    start = F.greatest(F.lit(0), F.col("start_line"))
    note = F.struct(start.alias("start_line"), F.greatest(start, "end_line").alias("end_line"), text.alias("message"))
    return zones.groupBy("file").agg(F.array_sort(F.collect_list(note)).alias("messages"))


def quiz_summary(answers: DataFrame) -> DataFrame:
    """Score, right and answered per session with the band shown at the end of a quiz."""
    out = answers.groupBy("session_id").agg(
        n_right().alias("correct"),
        F.count("*").alias("total"),
        percent(n_right(), F.count("*")).alias("score"),
    )
    label = F.format_string("%d of %d questions correct", "correct", "total")
    return out.withColumns({"band": band(F.col("score"), K.QUIZ_BANDS), "label": label})
