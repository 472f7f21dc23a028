"""The streaming operators, applied to events in batch form; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runtime
from ..sources.tables import table
from ..streaming import events as S
from ..streaming import ledgers as G
from .conversation_queries import LEDGER, TOPICS
from .registry import query


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return ntz(S.tumbling(S.timed(table(spark, d, "events"))), "start")


@query("events_sliding", "WITH w AS (SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), s AS (SELECT event_type, b AS start FROM w UNION ALL SELECT event_type, b - INTERVAL 12 HOUR FROM w) SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2")
def events_sliding(spark, d):
    return ntz(S.sliding(S.timed(table(spark, d, "events"))), "start")


@query("events_sessionized", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessionized(spark, d):
    return ntz(S.sessions(S.timed(table(spark, d, "events"))), "start", "end")


@query("events_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def events_deduplicated(spark, d):
    return S.timed(table(spark, d, "events")).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@query("events_running_totals", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_running_totals(spark, d):
    """The operator with keyed state, run as a stream over the whole table: the last totals of every user."""
    schema = table(spark, d, "events").schema
    users = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").cast("long").alias("user_id"), "event_type")
    return S.last_of_each(S.running_totals(users), ["user_id"])


@query("session_ledger_stream", f"WITH {LEDGER} SELECT conv_id, topic, first_turn, last_turn, n FROM g")
def session_ledger_stream(spark, d):
    """The topics of all conversations, from state that a stream over the messages keeps: the last entry of each."""
    messages, path = table(spark, d, "conversations"), runtime.new_path(spark, "messages")
    messages.repartitionByRange(3, "turn").write.parquet(path)
    live = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with G.state_store(spark):
        return S.last_of_each(G.ledgers(live, TOPICS), ["conv_id", "topic"]).select("conv_id", "topic", "first_turn", "last_turn", "n")
