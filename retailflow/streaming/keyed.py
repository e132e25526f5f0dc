"""Keyed state processors: devices that are forgotten some time after their last touch, and users'
first orders, started from a table. State lies in the state store and can be read back as a table.

Rows of a key arrive in pieces and in no order; a processor keeps of them only what the key's state
needs, so a key with very many rows in a batch takes no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class TouchExpiry(StatefulProcessor):
    """Lets a key's row through when the key has not been touched for `ttl` milliseconds. Every touch renews; the
    state goes `ttl` after the last one, by event time.

    A batch may hold several of a key's live spans: touches less than `ttl` apart are one span, of which only the first
    and last time are kept."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts bigint")

    def _joined(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for first, last in sorted(spans):
            if out and first - out[-1][1] < self.ttl:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans: list[tuple[int, int]] = []
        for piece in rows:
            spans = self._joined(spans + [(int(t), int(t)) for t in piece["ts"].drop_duplicates()])
        known = self.last.get()[0] if self.last.exists() else None
        fresh = []
        for first, last in spans:
            if known is None or first - known >= self.ttl:
                fresh.append(first)
            known = last if known is None else max(known, last)
        self.last.update((known,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(known + self.ttl)
        if fresh:
            yield pd.DataFrame({"mid": [key[0]] * len(fresh), "ts": fresh})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_active(startups: DataFrame, ttl: str = "24 hours", watermark: str = "1 hour") -> DataFrame:
    """(mid, ts) whenever a device starts that has not started for `ttl`. startups: mid, ts (ms)."""
    length = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = startups.select("mid", "ts", F.timestamp_millis("ts").alias("at")).withWatermark("at", watermark)
    return rows.groupBy("mid").transformWithStateInPandas(TouchExpiry(length), "mid string, ts bigint", "Append", "EventTime")


class FirstOrder(StatefulProcessor):
    """The first order of each user, as far as orders have come: (create_time, id). A user that a table
    names as known from before has none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "known boolean, create_time string, id bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if not self.first.exists():
            known = initialState.order_id is None
            self.first.update((known, None if known else initialState.create_time, None if known else int(initialState.order_id)))

    @staticmethod
    def _time(order: tuple) -> tuple:
        """Orders by time and id; what is missing comes last."""
        return tuple(item for x, none in zip(order, ("", 0), strict=True) for item in (x is None, none if x is None else x))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = min(((r.create_time, r.id) for r in rows), key=self._time, default=None)
        state = self.first.get()
        if best is not None and (state is None or (not state[0] and self._time(best) < self._time((state[1], state[2])))):
            self.first.update((False, *best))
            yield Row(user_id=key[0], create_time=best[0], id=best[1])

    def close(self) -> None:
        pass


class FirstOrders(FirstOrder):
    """The first orders of a block of users, as FirstOrder keeps them, in one state: calls to the state, and rows on their way to it, go by
    blocks. Of a batch's orders a task holds one for each user of the block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "users array<struct<user_id bigint, known boolean, create_time string, id bigint>>")

    def _users(self) -> dict:
        state = self.first.get()
        return {user: (known, *order) for user, known, *order in state[0]} if state else {}

    def _keep(self, users: dict) -> None:
        self.first.update(([(user, *value) for user, value in users.items()],))

    @staticmethod
    def _rows(piece: pd.DataFrame) -> Iterator[tuple]:
        """User, time and id. Numbers come as texts: pandas would make those of a column with nulls inexact."""
        number = lambda x: None if x is None else int(x)
        return zip(map(number, piece["user_id"]), piece["create_time"], map(number, piece["id"]), strict=True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if not initialState.empty:
            users = self._users()
            for user, time, number in self._rows(initialState):
                users.setdefault(user, (number is None, None if number is None else time, number))
            self._keep(users)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for piece in rows:
            for user, time, number in self._rows(piece):
                order = (time is None, time or "", number is None, number or 0)
                if user not in best or order < best[user]:
                    best[user] = order
        users = self._users()
        earlier = {}
        for user, (no_time, time, no_number, number) in best.items():
            order = (None if no_time else time, None if no_number else number)
            if user not in users or (not users[user][0] and self._time(order) < self._time(users[user][1:])):
                earlier[user] = order
        if earlier:
            self._keep(users | {user: (False, *order) for user, order in earlier.items()})
            times, numbers = zip(*earlier.values(), strict=True)
            yield pd.DataFrame({"user_id": pd.array(list(earlier), "Int64"), "create_time": pd.Series(times, dtype=object), "id": pd.array(numbers, "Int64")})


def stream_first_orders(placed: DataFrame, user_state: DataFrame, blocks: int | None = None) -> DataFrame:
    """(user_id, create_time, id) whenever a user's first order becomes known or an earlier one comes. `user_state` (user_id,
    order_id, create_time) is where a new query starts from; one that is restarted goes on with its own state. State lies by user or, with
    `blocks`, by that many blocks of a hash of the user: for batches that meet many users. A checkpoint keeps to its number of blocks."""
    start = user_state.select(F.expr("try_cast(user_id AS bigint)").alias("user_id"), "order_id", "create_time")
    placed = placed.select("user_id", "create_time", "id")
    schema, mode = "user_id bigint, create_time string, id bigint", ("Update", "None")
    if blocks is None:
        return placed.groupBy("user_id").transformWithState(FirstOrder(), schema, *mode, initialState=start.groupBy("user_id"))

    def by_block(rows: DataFrame, number: str) -> GroupedData:
        user = F.col("user_id").cast("long")
        block = F.pmod(F.hash(user), F.lit(blocks))
        return rows.select(block.alias("block"), user.cast("string").alias("user_id"), "create_time", F.col(number).cast("string").alias("id")).groupBy("block")

    return by_block(placed, "id").transformWithStateInPandas(FirstOrders(), schema, *mode, initialState=by_block(start, "order_id"))


def read_state(spark: SparkSession, checkpoint: str, variable: str, batch_id: int | None = None) -> DataFrame:
    """A state variable of a query as a table: key and value, as of its last batch or an earlier one."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def read_first_orders(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """user_id, known, create_time, id: the state that stream_first_orders keeps by blocks, a row for each user."""
    return read_state(spark, checkpoint, "first", batch_id).select(F.explode("value.users").alias("user")).select("user.*")
