"""Question bank: findings turned into multiple-choice questions, and picks from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import once, render
from graspmeter.operators.detectors import describe
from graspmeter.question_texts import HOW_TO_FIX, OTHER, WHAT_HAPPENS
from graspmeter.rule_texts import RULES

_LABELS = ["A", "B", "C", "D"]


def difficulty_of(severity: Column) -> Column:
    entries = [F.lit(x) for pair in K.SEVERITY_DIFFICULTY.items() for x in pair]
    return F.element_at(F.create_map(*entries), severity)


def severity_rank(severity: Column) -> Column:
    entries = [F.lit(x) for pair in K.SEVERITY_RANK.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), severity), F.lit(4))


def question_id(kind: Column, file: Column, line: Column, variant: Column) -> Column:
    base = F.concat_ws("-", kind, F.regexp_replace(file, "[^a-zA-Z0-9]", "_"), line.cast("string"))
    return F.when(variant == 0, base).otherwise(F.concat(base, F.lit("-v"), variant.cast("string")))


def _text(variant: int, part: str) -> Column:
    """Template text of a rule as a literal map; rules without an own text are absent."""
    texts = (WHAT_HAPPENS, HOW_TO_FIX)[variant]
    entries = []
    for name in RULES:
        if part in texts[name]:
            value = texts[name][part]
            lit = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
            entries += [F.lit(name), lit]
    return F.element_at(F.create_map(*entries), F.col("type"))


def _variant_fields(variant: int) -> Column:
    """Question, correct option, wrong options and explanation of one variant."""
    fields = F.col("fields")

    def filled(part: str, default: Column) -> Column:
        template = _text(variant, part)
        return F.when(template.isNotNull(), render(template, fields)).otherwise(default)

    wrong = _text(variant, "wrong")
    rule_text = F.concat(F.col("correct_behavior"), F.lit("\n\n"), F.col("consequence"))
    return F.struct(
        filled("question", render(OTHER, fields)).alias("question"),
        filled("correct", F.col("correct_behavior")).alias("correct"),
        F.when(wrong.isNotNull(), F.transform(wrong, lambda w: render(w, fields)))
        .otherwise(F.slice("incorrect_assumptions", 1, 3))
        .alias("wrong"),
        (F.col("correct_behavior") if variant else rule_text).alias("explanation"),
    )


_RENDERED = once(lambda: F.when(F.col("variant") == 0, _variant_fields(0)).otherwise(_variant_fields(1)))


def shuffled(options: Column, key: Column, seed: int) -> Column:
    """Options in an order that depends only on the question and the seed, labelled A to D."""
    keyed = F.array_sort(
        F.transform(
            options,
            lambda o, i: F.struct(
                F.xxhash64(key, F.lit(seed), i).alias("h"), i.alias("i"), o["text"].alias("text"), o["is_correct"].alias("ok")
            ),
        )
    )
    labels = F.array(*[F.lit(x) for x in _LABELS])
    return F.transform(
        keyed,
        lambda o, i: F.struct(
            F.get(labels, i).alias("label"), o["text"].alias("text"), o["ok"].alias("is_correct")
        ),
    )


def _present(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def rejected_findings(findings: DataFrame) -> DataFrame:
    """Findings no question can be made of, with the field they lack."""
    lacks = F.coalesce(
        *[F.when(~_present(c), F.lit(c)) for c in ("type", "file", "func_name")]
    )
    return findings.withColumn("missing_field", lacks).where(F.col("missing_field").isNotNull())


def question_keys(findings: DataFrame, variants: str = "both") -> DataFrame:
    """One row per finding and variant with the question's id, no texts yet.

    ``variants`` is ``first``, ``fix`` or ``both``. A kind of finding without templates of its
    own has only the general question, whatever the variant.
    """
    wanted = {"first": [0], "fix": [1], "both": [0, 1]}[variants]
    own = F.col("type").isin(*RULES)
    complete = findings.where(_present("type") & _present("file") & _present("func_name"))
    return (
        complete.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in wanted])))
        .withColumn("variant", F.when(own, F.col("variant")).otherwise(0))
        .withColumn("id", question_id(F.col("type"), F.col("file"), F.col("line"), F.col("variant")))
    )


def render_keys(keys: DataFrame, seed: int = 0) -> DataFrame:
    """Questions of the rows of ``question_keys`` (described here if they are not yet)."""
    if "correct_behavior" not in keys.columns:
        keys = describe(keys)
    fields = F.map_concat(
        "evidence",
        F.create_map(
            F.lit("function"), F.col("func_name"),
            F.lit("file"), F.col("file"),
            F.lit("line_1"), (F.col("line") + 1).cast("string"),
            F.lit("description"), F.col("description"),
        ),
    )
    q = keys.withColumn("fields", fields).withColumn("q", _RENDERED())
    options = F.concat(
        F.array(F.struct(F.col("q.correct").alias("text"), F.lit(True).alias("is_correct"))),
        F.transform("q.wrong", lambda w: F.struct(w.alias("text"), F.lit(False).alias("is_correct"))),
    )
    return q.select(
        "id",
        "variant",
        "type",
        "severity",
        F.col("q.question").alias("question"),
        difficulty_of(F.col("severity")).alias("difficulty"),
        "category",
        F.struct(
            "file",
            F.col("line").alias("start_line"),
            F.coalesce("end_line", F.col("line") + 5).alias("end_line"),
        ).alias("code_reference"),
        shuffled(options, F.col("id"), seed).alias("options"),
        F.col("q.explanation").alias("explanation"),
        F.col("consequence").alias("danger_note"),
    )


def render_questions(findings: DataFrame, variants: str = "both", seed: int = 0) -> DataFrame:
    """Questions of findings, both variants each by default."""
    return render_keys(question_keys(findings, variants), seed)


# --- picking ------------------------------------------------------------------------------


def severities_for(difficulty: int) -> list[str]:
    if difficulty <= 2:
        return ["low", "medium"]
    return ["medium", "high"] if difficulty == 3 else ["high", "critical"]


def focus(findings: DataFrame, files: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """Keep findings of the given files (column ``file``) and of one category."""
    if files is not None:
        findings = findings.join(files.select("file").distinct(), "file", "left_semi")
    return findings.where(F.col("category") == category) if category else findings


def by_difficulty(findings: DataFrame, difficulty: int) -> DataFrame:
    return findings.where(F.col("severity").isin(*severities_for(difficulty)))


def first_per_rule(findings: DataFrame) -> DataFrame:
    """One finding per rule, function name and file: the first in the file.

    ``min_by`` keeps one row per key on the map side, so a hot file does not pile up.
    """
    keys = ["type", "func_name", "file"]
    rest = [c for c in findings.columns if c not in keys]
    line_of_function = F.substring_index("func_id", "#", -1).cast("int")
    return (
        findings.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(line_of_function, "pos")).alias("x"))
        .select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])
        .select(*findings.columns)
    )


def fresh_pool(keys: DataFrame, shown: DataFrame | None, n: int, order: list[Column]) -> DataFrame:
    """First ``n`` questions not shown yet; if all have been shown, the first ``n`` of those.

    A top-n by (seen, order): an unseen question, if any, is among them, so the choice of
    the pool needs only these n rows. Works on ``question_keys``, so only picked questions
    are rendered.
    """
    if shown is None:
        return keys.orderBy(*order).limit(n)
    seen = shown.select(F.col("question_id").alias("id")).distinct().withColumn("seen", F.lit(1))
    ranked = keys.join(seen, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    top = ranked.orderBy("seen", *order).limit(n)
    pool = F.min("seen").over(Window.partitionBy())
    return top.withColumn("pool", pool).where(F.col("seen") == F.col("pool")).drop("pool", "seen")


def pick_order() -> list[Column]:
    """By severity, then in order of files, functions and findings."""
    return [
        F.col("severity_rank"),
        F.col("file"),
        F.substring_index("func_id", "#", -1).cast("int"),
        F.col("pos"),
        F.col("variant"),
    ]


def count_available(findings: DataFrame) -> DataFrame:
    """Number of findings: in total, by category and by severity."""
    # Counted per pair first, so that the grouping sets only expand a handful of rows.
    pairs = findings.groupBy("category", "severity").agg(F.count("*").alias("n"))
    counted = pairs.groupingSets(
        [[], [F.col("category")], [F.col("severity")]], F.col("category"), F.col("severity")
    ).agg(F.sum("n").alias("n"))
    return counted.select(
        F.when(F.col("category").isNotNull(), "category")
        .when(F.col("severity").isNotNull(), "severity")
        .otherwise("total")
        .alias("dimension"),
        F.coalesce("category", "severity", F.lit("total")).alias("value"),
        "n",
    )


def prioritize(
    critical: DataFrame,
    scores: DataFrame,
    focus_area: str | None = None,
    pinned: DataFrame | None = None,
) -> DataFrame:
    """Risky files with their priority ``risk * (1 - score/100)``; no score counts as 100.

    Pinned files win over a focus area, which is a category or a part of the path.
    """
    rows = critical
    if pinned is not None:
        rows = rows.join(pinned.select("file").distinct(), "file", "left_semi")
    elif focus_area:
        rows = rows.where((F.col("category") == focus_area) | F.col("file").contains(focus_area))
    known = scores.select("file", "score")
    return rows.join(known, "file", "left").withColumn(
        "priority", F.col("risk_level") * (1 - F.coalesce("score", F.lit(100)) / 100)
    )


def _picked(findings: DataFrame, files: DataFrame | None, category: str | None, difficulty: int | None):
    rows = focus(findings, files, category)
    if difficulty is not None:
        rows = by_difficulty(rows, difficulty)
    return question_keys(first_per_rule(rows))


def session_questions(
    findings: DataFrame,
    candidates: DataFrame,
    shown: DataFrame | None,
    n: int = 10,
    difficulty: int | None = None,
    category: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Questions of one session: by severity, then candidate files in order of priority.

    ``candidates(file, priority)`` as ``prioritize`` gives them; ``findings`` as
    ``detectors.detect_all`` does.
    """
    files = candidates.groupBy("file").agg(F.max("priority").alias("priority"))
    keys = _picked(findings.join(files, "file"), None, category, difficulty)
    order = pick_order()
    order.insert(1, F.col("priority").desc())
    return render_keys(fresh_pool(keys, shown, n, order), seed)


def local_questions(
    findings: DataFrame,
    max_questions: int,
    difficulty: int | None = None,
    category: str | None = None,
    files: DataFrame | None = None,
    shown: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """From all findings of a corpus to the first ``max_questions`` questions."""
    keys = _picked(findings, files, category, difficulty)
    return render_keys(fresh_pool(keys, shown, max_questions, pick_order()), seed)
