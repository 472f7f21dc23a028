"""Session state as a stream: topics in a map state with a cap, the last messages in a list state, an end by timer.

The same fold as operators.sessions.ledger() and recent(), a micro-batch at a time: what a batch brings
is added to the state of its conversations, and the entries that it changed come out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Topics of a conversation that its state holds, messages that it holds, how long state lives without a word (milliseconds; 0: for ever).
CAP, RECENT, IDLE_MS = 80, 12, 0

ENTRIES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()), T.StructField("n", T.LongType()), T.StructField("kind", T.StringType())])


@contextmanager
def state_store(spark: SparkSession):
    """State in RocksDB, which map and list states need, for queries that start inside; the session's own setting is back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Ledger(StatefulProcessor):
    """Rows of one conversation: conv_id, turn, role, text. Gives the entries that changed ("entry"), those that the cap drops ("dropped", those seen longest ago, then by name), and "ended" for a conversation whose timer ran out."""

    def __init__(self, topics: Sequence[str], cap: int = CAP, recent: int = RECENT, idle_ms: int = IDLE_MS):
        self.words, self.cap, self.keep, self.idle = tuple(topics), cap, recent, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = 10 * self.idle or None  # the timer clears the state before; this holds for state whose timer was lost
        self.topics = handle.getMapState("topics", T.StructType([T.StructField("topic", T.StringType())]), T.StructType([T.StructField(c, T.LongType()) for c in ("first_turn", "last_turn", "n")]), ttl)
        self.recent = handle.getListState("recent", T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]), ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: tuple(v) for k, v in self.topics.iterator()} if self.topics.exists() else {}
        last = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        changed, before = set(), set(held)
        for b in rows:
            for turn, role, text in zip(b["turn"].tolist(), b["role"].tolist(), b["text"].tolist(), strict=True):
                last.append((int(turn), role, text))
                low = (text or "").lower()
                for w in self.words if role == "user" else ():
                    if w in low:
                        a, z, n = held.get(w, (turn, turn, 0))
                        held[w] = (min(a, int(turn)), max(z, int(turn)), n + 1)
                        changed.add(w)
        kept = sorted(held, key=lambda w: (-held[w][1], w))[: self.cap]
        dropped = [w for w in held if w not in set(kept)]
        for w in kept:
            if w in changed:
                self.topics.updateValue((w,), held[w])
        for w in dropped:
            if w in before:
                self.topics.removeKey((w,))
        self.recent.put(sorted(last, key=lambda x: x[0])[-self.keep :])
        if self.idle:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old if isinstance(old, int) else old[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        out = [(key[0], w, *held[w], "entry") for w in sorted(changed) if w in kept] + [(key[0], w, *held[w], "dropped") for w in sorted(dropped) if w in before]
        yield pd.DataFrame(out, columns=ENTRIES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = len(list(self.topics.keys())) if self.topics.exists() else 0
        self.topics.clear()
        self.recent.clear()
        yield pd.DataFrame([(key[0], None, None, None, n, "ended")], columns=ENTRIES.names).astype({"first_turn": "Int64", "last_turn": "Int64"})

    def close(self) -> None:
        pass


def ledgers(messages: DataFrame, topics: Sequence[str], *, cap: int = CAP, recent: int = RECENT, idle_ms: int = IDLE_MS) -> DataFrame:
    """ENTRIES of a stream of messages (conv_id, turn, role, text). Rows without a conversation or turn are left out; texts may be null. Start the query inside state_store(). With idle_ms, batches follow the clock: run it with a processing-time trigger, as one over what is available would not end."""
    rows = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text")
    mode = "ProcessingTime" if idle_ms else "None"
    return rows.groupBy("conv_id").transformWithStateInPandas(Ledger(topics, cap, recent, idle_ms), ENTRIES, "Update", mode)
