"""Stateful streams: rounds of scores, health of sources, windowed counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.health import Alert, next_alert
from tidemark.operators.history import push_round


def history_stream(rounds: DataFrame) -> DataFrame:
    """(feed, ts, slots, mean): after each round of a feed its slots and the mean score over them.

    rounds is a stream of (feed string, ts long, score double), a row a round; a feed's rounds in one batch are taken in
    order of time. The same fold as push_round() over a table.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots = [tuple(s) for s in json.loads(state.get[0])] if state.exists else []
        rows = []
        new = pd.concat(list(batches)).sort_values(["ts", "score"], kind="stable")
        for ts, score in zip(new["ts"], new["score"]):
            slots = push_round(slots, int(ts), float(score))
            rows.append((key[0], int(ts), len(slots), sum(s[1] for s in slots) / len(slots)))
        state.update((json.dumps(slots),))
        yield pd.DataFrame(rows, columns=["feed", "ts", "slots", "mean"])

    return rounds.groupBy("feed").applyInPandasWithState(fold, "feed string, ts long, slots int, mean double", "slots string", "append", GroupStateTimeout.NoTimeout)


def alert_stream(runs: DataFrame) -> DataFrame:
    """(feed, ts, streak, notify, close) of a stream of runs (feed string, ts long, hour int, problem string)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = Alert(*state.get) if state.exists else Alert()
        rows = []
        for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            was, notify, close = next_alert(was, r.problem or "", int(r.hour))
            rows.append((key[0], int(r.ts), was.streak, notify, close))
        state.update((was.streak, was.key, was.close_left))
        yield pd.DataFrame(rows, columns=["feed", "ts", "streak", "notify", "close"])

    return runs.groupBy("feed").applyInPandasWithState(fold, "feed string, ts long, streak int, notify boolean, close boolean", "streak int, key string, close_left int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of event-time windows; events later than late are dropped by the watermark. A ts without
    a zone is taken as UTC, as watermarks need a timestamp."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def in_batches(stream: DataFrame, write, checkpoint: str):
    """Run write(frame, number) on each batch, exactly once in order of number; write should replace by number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
