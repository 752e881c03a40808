"""The log as a stream: idempotent intake, windowed tail statistics, and the wake trigger as streaming state."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import cjk_count, word_count
from ..operators.log import DEDUP_KEY
from ..operators.triggers import Wake


def first_writes(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Rows whose dedup key was not seen before. With ``late`` the state forgets keys that long after their event time,
    without it redelivery at any later time is caught and the state grows with the log."""
    if late is None:
        return stream.dropDuplicates(DEDUP_KEY)
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(DEDUP_KEY)


def tail_windows(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Conversational rows, bytes, characters of scripts without blanks and words by chat and window of event time."""
    rows = stream.where("event_type not in ('join', 'leave')").withWatermark("timestamp", late)
    return rows.groupBy("chat_id", F.window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(cjk_count(F.col("text"))).alias("chars_cjk"),
        F.sum(word_count(F.col("text"))).alias("words"),
    ).select("chat_id", F.col("w.start").alias("start"), "messages", "bytes", "chars_cjk", "words")


def wake_fires(stream: DataFrame) -> DataFrame:
    """(chat_id, id, reason) as in the batch fold: between micro-batches only each chat's last wake and count are kept. Rows of one
    micro-batch are taken in order of id; rows that arrive later are taken when they arrive."""
    rows = stream.where("direction = 'inbound' and event_type not in ('join', 'leave')").select("chat_id", "id", F.unix_timestamp("timestamp").alias("t"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (-1, 0)
        wake, out = Wake(None if last < 0 else last, count), []
        for batch in [pd.concat(list(batches))]:
            for row in batch.sort_values("id").itertuples():
                if reason := wake.step(int(row.t)):
                    out.append((key[0], int(row.id), reason))
        state.update((-1 if wake.last is None else wake.last, wake.count))
        yield pd.DataFrame(out, columns=["chat_id", "id", "reason"])

    return rows.groupBy("chat_id").applyInPandasWithState(
        step, "chat_id string, id long, reason string", "last long, count long", "append", GroupStateTimeout.NoTimeout)
