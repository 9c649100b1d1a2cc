"""Admission as Structured Streaming: state a subject, in the order of event time of each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "subject string, request_id long, ts timestamp, admitted boolean, reason string"
STATE = "day string, used int, minutes array<long>, counts array<int>"


def admitted(requests: DataFrame, daily: int, per_hour: int, lateness: str = "10 minutes") -> DataFrame:
    """Decides each request (subject, request_id, ts): first the burst of the sliding hour, then the day's quota; refusals are not counted.

    A subject's state is its day, the tokens used, and the minutes of the last hour; it is dropped a day after the watermark has passed.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day, used, minutes, counts = state.get if state.exists else ("", 0, [], [])
        hour = list(zip(minutes, counts, strict=True))
        pdf = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        rows = []
        for request, ts in zip(pdf["request_id"], pdf["ts"], strict=True):
            second, today = int(ts.timestamp()), str(ts.date())
            if today != day:
                day, used = today, 0
            hour = [(m, n) for m, n in hour if m > second - 3600]
            reason = "burst" if sum(n for _, n in hour) >= per_hour else "quota" if used >= daily else None
            if reason is None:
                used += 1
                minute = second // 60 * 60
                if hour and hour[-1][0] == minute:
                    hour[-1] = (minute, hour[-1][1] + 1)
                else:
                    hour.append((minute, 1))
            rows.append((key[0], request, ts, reason is None, reason))
        state.update((day, used, [m for m, _ in hour], [n for _, n in hour]))
        state.setTimeoutTimestamp(int(pdf["ts"].max().timestamp() * 1000) + 86_400_000)
        yield pd.DataFrame(rows, columns=["subject", "request_id", "ts", "admitted", "reason"])

    marked = requests.select(F.col("subject").cast("string").alias("subject"), "request_id", "ts").withWatermark("ts", lateness)
    return marked.groupBy("subject").applyInPandasWithState(decide, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def single_use(solutions: DataFrame, valid: str = "1 hour") -> DataFrame:
    """Each token (token, ts) once within its validity."""
    return solutions.withWatermark("ts", valid).dropDuplicatesWithinWatermark(["token"])


def refusal_counts(decisions: DataFrame) -> DataFrame:
    """day, reason, n of refused requests."""
    return decisions.where("NOT admitted").groupBy(F.to_date("ts").alias("day"), "reason").agg(F.count("*").alias("n"))
