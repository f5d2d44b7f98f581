"""Adaptive difficulty with each user's level and streak in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graspmeter import constants as K
from graspmeter.operators import grading

#: Level and streak as one number (``grading.next_state``), answers counted, late ones, and the last answer's place.
STATE = "state int, answered long, late long, last_us long, last_id long"
OUTPUT = "user_id long, state int, answered long, late long, expired boolean"
_NO_PLACE = -(1 << 63)


def adaptive_states(
    answers: DataFrame, idle_seconds: int | None = None, delay: str = "0 seconds", start_level: int = K.START_LEVEL
) -> DataFrame:
    """A stream of ``user_id, state, answered, late, expired``, a row for each user that a micro-batch touches.

    ``answers(answer_id, user_id, ts, is_correct)``. Within a micro-batch a user's answers are
    taken by time and id; an answer that is not behind the user's last one (older, or repeated)
    is late: it is counted and changes nothing. Answers without user, time or id don't count.
    With ``idle_seconds`` a user is given up when the watermark passes the last answer by as
    much: a last row comes out, the store forgets the user, and who comes back starts anew.

    The store has a row for each user, and a micro-batch reads and writes those of its own users
    only. What one user answers within one micro-batch is sorted in one task, so its size is the
    trigger's (``maxFilesPerTrigger``). Write update mode.
    """
    fresh = (start_level - K.MIN_LEVEL) * 4
    moves = {ok: [grading.next_state(state, ok) for state in range(4 * (K.MAX_LEVEL - K.MIN_LEVEL + 1))] for ok in (False, True)}
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, answered, late, last_us, last_id = kept.get if kept.exists else (fresh, 0, 0, _NO_PLACE, _NO_PLACE)
        expired = kept.hasTimedOut
        if not expired:
            rows = [row for frame in frames for row in zip(*(frame[c].tolist() for c in ("us", "answer_id", "is_correct")))]
            for us, answer_id, is_correct in sorted(rows):
                if (us, answer_id) <= (last_us, last_id):
                    late += 1
                    continue
                state, answered, last_us, last_id = moves[is_correct][state], answered + 1, us, answer_id
        if expired:
            kept.remove()
        else:
            kept.update((state, answered, late, last_us, last_id))
            if idle_seconds is not None:
                kept.setTimeoutTimestamp(max(last_us // 1000 + 1000 * idle_seconds, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "state": [state], "answered": [answered], "late": [late], "expired": [expired]})

    usable = answers.where("user_id is not null and ts is not null and answer_id is not null")
    timed = usable.withWatermark("ts", delay).select("user_id", "answer_id", F.unix_micros("ts").alias("us"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"), "ts")
    return timed.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "update", timeout)


def levels_of(states: DataFrame) -> DataFrame:
    """Level and streaks as columns."""
    streak = F.col("state") % 4
    return states.withColumns(
        {
            "level": grading.level_of(F.col("state")),
            "right_streak": F.when(streak < 3, streak).otherwise(0),
            "wrong_streak": F.when(streak == 3, 1).otherwise(0),
        }
    ).drop("state")
