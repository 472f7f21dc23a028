"""Turn-synchronous replay and streamed session state against plain folds; restarts, caps and timers."""

import os
import random
import time

from pyspark.sql import functions as F

from quern.operators import replay as Y
from quern.operators import sessions as M
from quern.streaming import ledgers as G

WORDS = ("red", "green", "blue", "grey", "pink", "gold", "teal")


def talks(seed, n=25):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(0, 9)):
            text = " ".join(r.choice([*WORDS, "x", "y", "z", "w"]) for _ in range(r.randint(0, 4)))
            rows.append((c, t, r.choice(["user", "user", "assistant"]), r.choice([text, text, text, None])))
    return rows


MESSAGES = "conv_id long, turn long, role string, text string"


def plain_replay(rows, docs, results=3, carried=8):
    out = []
    newest = {w: [d for d, ts, t in sorted(docs, key=lambda x: (-x[1], x[0])) if w in t.lower()] for w in WORDS}
    for c in sorted({r[0] for r in rows}):
        terms, evidence, n = [], [], 0
        for _, turn, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if role != "user":
                continue
            n += 1
            terms = [w for w in WORDS if w in (text or "").lower()][:6] or terms
            got = []
            for w in terms:
                got += [d for d in newest[w] if d not in evidence and d not in got]
            got = got[:results]
            evidence = list(dict.fromkeys(evidence + got))[-carried:]
            out.append((c, turn, n, tuple(terms), tuple(got), tuple(evidence)))
    return sorted(out)


def test_replay_is_plain(spark):
    r = random.Random(1)
    docs = [(k, r.randint(0, 40), " ".join(r.choice([*WORDS, "q"]) for _ in range(r.randint(0, 3)))) for k in range(60)]
    rows = talks(3)
    m = spark.createDataFrame(rows + [(None, 1, "user", "red"), (99, None, "user", "red"), rows[0]], MESSAGES).withColumns({"n": F.lit(1), "terms": F.lit("clash")})
    d = spark.createDataFrame(docs, "doc_id long, publish_ts long, text string")
    from quern.functions import text as X

    got = Y.replayed(m, lambda c: X.vocabulary_hits(F.lower(X.text(c)), WORDS), Y.newest_unseen(d, "text", WORDS)).collect()
    assert sorted((x["conv_id"], x["turn"], x["n"], tuple(x["terms"]), tuple(x["results"]), tuple(x["evidence"])) for x in got) == plain_replay(rows, docs)
    assert Y.replayed(m.limit(0), lambda c: F.array(c), Y.newest_unseen(d, "text", WORDS)).count() == 0


def kept(out):
    """The last entry of each topic, in the order in which batches gave them; dropped ones leave."""
    state = {}
    for r in out:
        k = (r["conv_id"], r["topic"])
        if r["kind"] == "entry":
            state[k] = (r["first_turn"], r["last_turn"], r["n"])
        else:
            state.pop(k, None)
    return state


def run(spark, src, out, cp, **options):
    schema = spark.createDataFrame([], MESSAGES).schema
    with G.state_store(spark):
        live = G.ledgers(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), WORDS, **options)
        q = live.writeStream.outputMode("update").foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).coalesce(1).write.mode("overwrite").parquet(f"{out}/b={k}")).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return q


def test_stream_is_the_batch_and_restarts(spark, tmp_path):
    rows = talks(8, 12)
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    frame = spark.createDataFrame(rows, MESSAGES)
    for t in range(0, 3):
        frame.filter(f"turn = {t}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.1)
    run(spark, src, out, cp)
    first = spark.read.parquet(out).select("batch").distinct().count()
    for t in range(3, 9):  # the stream has ended; a new one goes on from the checkpoint
        frame.filter(f"turn = {t}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.1)
    run(spark, src, out, cp)
    told = spark.read.parquet(out).orderBy("batch").collect()
    assert len({r["batch"] for r in told}) > first
    want = {(r["conv_id"], r["topic"]): (r["first_turn"], r["last_turn"], r["n"]) for r in M.ledger(frame, WORDS).collect()}
    assert kept(told) == want
    assert spark.conf.get(G.PROVIDER, "") != G.ROCKS


def test_cap_holds_in_the_state(spark, tmp_path):
    rows = [(1, t, "user", w) for t, w in enumerate(["red", "green", "blue", "red pink", "gold gold"])]
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    frame = spark.createDataFrame(rows, MESSAGES)
    for t in range(5):
        frame.filter(f"turn = {t}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.1)
    run(spark, src, out, cp, cap=3)
    assert kept(spark.read.parquet(out).orderBy("batch", F.desc("kind")).collect()) == {(1, "red"): (0, 3, 2), (1, "pink"): (3, 3, 1), (1, "gold"): (4, 4, 1)}


def test_idle_conversations_end(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    frame = spark.createDataFrame([(1, 0, "user", "red green")], MESSAGES)
    frame.coalesce(1).write.mode("append").parquet(src)
    with G.state_store(spark):
        live = G.ledgers(spark.readStream.schema(frame.schema).parquet(src), WORDS, idle_ms=4000)
        q = live.writeStream.outputMode("update").foreachBatch(lambda b, k: b.coalesce(1).write.mode("overwrite").parquet(f"{out}/b={k}")).option("checkpointLocation", cp).trigger(processingTime="1 second").start()
        try:
            told = []
            for _ in range(60):
                time.sleep(0.5)
                batches = [f"{out}/{x}" for x in os.listdir(out) if os.path.exists(f"{out}/{x}/_SUCCESS")] if os.path.exists(out) else []
                told = [(r["conv_id"], r["n"]) for r in spark.read.schema(G.ENTRIES).parquet(*batches).filter("kind = 'ended'").collect()] if batches else []
                if told:
                    break
        finally:
            q.stop()
    assert told == [(1, 2)]
