"""Scores and difficulty over a stream of answers.

``answers(answer_id, user_id, ts TIMESTAMP, is_correct)``. Each job gives the same result as
its batch counterpart on the same answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graspmeter.functions.scores import n_right, percent
from graspmeter.operators import grading
from graspmeter.session import work_dir
from graspmeter.sources import state


def running_scores(answers: DataFrame, delay: str) -> DataFrame:
    """Right and answered per user so far; repeated answers count once, too late ones not at all."""
    unique = answers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["answer_id"])
    return unique.groupBy("user_id").agg(
        n_right().alias("correct"),
        F.count("*").alias("answered"),
        percent(n_right(), F.count("*")).alias("score"),
    )


def windowed_scores(answers: DataFrame, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Scores per tumbling window, or per sliding window if ``slide`` is given."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        answers.withWatermark("ts", delay)
        .groupBy(window.alias("w"))
        .agg(n_right().alias("correct"), F.count("*").alias("answered"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "correct",
            "answered",
            percent(F.col("correct"), F.col("answered")).alias("score"),
        )
    )


def gap_sessions(answers: DataFrame, delay: str, gap: str) -> DataFrame:
    """Sessions of a user: answers with less than ``gap`` between them.

    In append mode a session comes out when the watermark has passed its end.
    """
    return (
        answers.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(n_right().alias("correct"), F.count("*").alias("answered"))
        .select(
            "user_id",
            F.col("w.start").alias("session_start"),
            F.col("w.end").alias("session_end"),
            "correct",
            "answered",
            percent(F.col("correct"), F.col("answered")).alias("score"),
        )
    )


def answer_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of an answer log as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


LATE = "batch_id long, rows long"


def write_table(df: DataFrame, mode: str, folder: str | None = None) -> tuple[StreamingQuery, str]:
    """Run a stream over all available input into a Parquet table in the shared folder.

    Update-mode rows get the number of their micro-batch. A batch that is run again after a
    failure overwrites its own files, so nothing is written twice.
    """
    spark = df.sparkSession
    base = folder or work_dir(spark, "stream")

    late: dict[int, int] = {}
    running: list[StreamingQuery] = []

    def note_late() -> None:
        # A query keeps its last hundred batches only, so they are noted as it goes.
        for done in running[0].recentProgress if running else ():
            late[done.batchId] = sum(op.numRowsDroppedByWatermark for op in done.stateOperators)

    def sink(batch: DataFrame, batch_id: int) -> None:
        note_late()
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{base}/out/run={batch_id}"
        )

    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.append(query)
    query.awaitTermination()
    note_late()
    spark.createDataFrame(list(late.items()), LATE).write.mode("append").parquet(f"{base}/late")
    return query, f"{base}/out"


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Last row per key of a table written in update mode."""
    rows = spark.read.parquet(folder).drop("run")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("x"))
        .select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])
    )


def dropped_late(spark: SparkSession, out: str) -> int:
    """Rows that a stream written by ``write_table`` dropped as older than the watermark, in all its runs."""
    late = spark.read.schema(LATE).parquet(f"{out.rsplit('/', 1)[0]}/late")
    return late.groupBy("batch_id").agg(F.max("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def _generations(
    df: DataFrame, store: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]
) -> tuple[StreamingQuery, str | None]:
    """Carry a table through the micro-batches of a stream: ``table = merge(batch, table)``.

    Two folders take turns, so a batch that is run again after a failure still finds the
    table it started from. Gives the query and the folder of the last table, None before any data.
    """
    spark = df.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{store}/gen={(batch_id - 1) % 2}") if batch_id else None
        merge(batch, before).write.mode("overwrite").parquet(f"{store}/gen={batch_id % 2}")
        spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("append").parquet(f"{store}/done")

    query = (
        df.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # A restart without new data runs no batch, so the store itself tells the last one.
    try:
        last = spark.read.schema("batch_id long").parquet(f"{store}/done").agg(F.max("batch_id")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return query, None if last is None else f"{store}/gen={last % 2}"


def adaptive_levels(answers: DataFrame, store: str | None = None) -> DataFrame:
    """Adaptive difficulty per user, carried from one micro-batch to the next.

    A micro-batch is folded like the batch job does it (hot users in parallel runs) and then
    applied to the state each user had. Files of the source have to come in time order (write
    them with ``repartitionByRange`` on the time); within a micro-batch order does not matter.
    """
    spark = answers.sparkSession
    rows = answers.select("user_id", "answer_id", "ts", "is_correct")

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        new = grading.run_tables(batch, "user_id", ["ts", "answer_id"])
        fresh = grading.state_of(grading.start_level())
        if before is None:
            state, answered = fresh, F.col("answered")
        else:
            new = new.withColumnRenamed("answered", "new_answered").join(before, "user_id", "full")
            state = F.coalesce("state", fresh)
            answered = F.coalesce("answered", F.lit(0)) + F.coalesce("new_answered", F.lit(0))
        after = F.when(F.col("tables").isNull(), state).otherwise(
            grading.apply_tables(F.col("tables"), state)
        )
        return new.select("user_id", answered.alias("answered"), after.alias("state"))

    _, folder = _generations(rows, store or work_dir(spark, "levels"), merge)
    if folder is None:
        none = answers.sparkSession.createDataFrame([], rows.schema)
        return grading.adaptive_difficulty(none, "user_id", ["ts", "answer_id"]).select("user_id", "answered", "level")
    return spark.read.parquet(folder).select(
        "user_id", "answered", grading.level_of(F.col("state")).alias("level")
    )


def upsert_stream(changes: DataFrame, key: str, version: str, store: str | None = None) -> DataFrame:
    """Newest row per key of a stream of changes (saved sessions, for instance)."""
    spark = changes.sparkSession

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        current = batch.where(F.lit(False)) if before is None else before.select(*batch.columns)
        return state.upsert(current, batch, key, F.col(version))

    _, folder = _generations(changes, store or work_dir(spark, "upsert"), merge)
    return spark.createDataFrame([], changes.schema) if folder is None else spark.read.parquet(folder)
