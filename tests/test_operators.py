"""Edge cases of operators on small literal fixtures."""

import random

from pyspark.sql import functions as F

from quern.functions import dates as D
from quern.functions import scores as S
from quern.functions import text as X
from quern.operators import corpus as C
from quern.operators import evaluation as E
from quern.operators import graph as G
from quern.operators import ranking as K
from quern.operators import relational as R
from quern.operators import sessions as M


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens_of_other_scripts(spark):
    assert one(spark, "GDP 增长 gdp 2023", X.rank_tokens) == ["gdp", "2023", "增", "长"]
    assert one(spark, "中国经济增长的 data", lambda c: X.keywords(c, ["的"])) == ["中国", "国经", "经济", "济增", "增长", "data"]
    assert one(spark, None, X.rank_tokens) == []
    assert one(spark, "Hello, a big-world a", lambda c: X.keywords(c)) == ["hello", "big", "world"]


def test_longest_common(spark):
    df = spark.createDataFrame([("中国 经济增长", "关于中国经济增长的报告"), ("", "x"), (None, "x"), ("abcdef", "zabcy")], "a string, b string")
    assert [r[0] for r in df.select(X.longest_common(F.col("a"), F.col("b"))).collect()] == [6, 0, 0, 3]


def test_windows_at_the_boundary(spark):
    f = lambda c: X.windows(c, 10, 4)
    assert one(spark, "", f) == []
    assert one(spark, "a" * 10, f) == ["a" * 10]
    assert one(spark, "a" * 11, f) == ["a" * 10, "a" * 5]


def test_packed_chunks(spark):
    got = one(spark, "\n".join(["x" * 300, "y" * 290, "z" * 100]), X.packed_chunks)
    assert len(got) == 2 and got[0].startswith("x") and got[1].endswith("z" * 100) and got[1].startswith("y")


def test_dates(spark):
    assert str(one(spark, "on 2024-2-29.", D.day_in)) == "2024-02-29"
    assert one(spark, "on 2023-02-30", D.day_in) is None
    assert one(spark, "", lambda c: D.parsed(c, "2024-01-01"))["status"] == "missing"
    assert one(spark, "2024-05-01", lambda c: D.parsed(c, "2024-01-01"))["status"] == "future"
    x = one(spark, "2023-02 late", D.third_of_month)
    assert (str(x["first"]), str(x["last"])) == ("2023-02-21", "2023-02-28")
    assert one(spark, "events of 2023-05-06", D.constraint)["kind"] == "day"


def test_equal_scores_normalise(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.0), (2, 0.0), (3, 1.0), (3, 3.0)], "query_id int, v double")
    got = {(r[0], r[1]) for r in df.select("query_id", S.min_max(F.col("v"), "query_id")).collect()}
    assert got == {(1, 1.0), (2, 0.0), (3, 0.0), (3, 1.0)}


def test_guard_at_the_threshold(spark):
    df = spark.createDataFrame([(1, i, i < 5) for i in range(8)] + [(2, i, i < 4) for i in range(8)], "query_id int, doc_id int, good boolean")
    got = K.guarded(df, F.col("good"), 5).groupBy("query_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 5, 2: 8}


def diversity(rows, most=2, window=10, tolerance=2.0):
    """The greedy rule in plain Python, for rows of (source, score) in order."""
    head, rest = rows[:window], rows[window:]
    kept, late, used = [], [], {}
    for i, (s, f) in enumerate(head):
        if used.get(s, 0) < most or not any(t != s and used.get(t, 0) < most and g >= f - tolerance for t, g in head[i + 1 :]):
            used[s] = used.get(s, 0) + 1
            kept.append((s, f))
        else:
            late.append((s, f))
    return kept + late + rest


def test_diversity_against_plain_python(spark):
    r = random.Random(4)
    data, want = [], {}
    for q in range(30):
        rows = sorted(((r.choice("abc"), round(r.uniform(0, 6), 3)) for _ in range(14)), key=lambda x: -x[1])
        want[q] = diversity(rows)
        data += [(q, i + 1, s, f) for i, (s, f) in enumerate(rows)]
    got = K.diversified(spark.createDataFrame(data, "query_id int, rank int, source string, final_score double")).orderBy("query_id", "final_rank").collect()
    for q in want:
        assert [(x["source"], x["final_score"]) for x in got if x["query_id"] == q] == want[q]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in G.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in parent}


def test_groups_by_token(spark):
    df = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["b"]), ("r3", ["c"]), ("r4", [])], "id string, t array<string>")
    got = {x["id"]: x["group_key"] for x in G.groups_by_token(df, "id", "t").collect()}
    assert got["r1"] == got["r2"] == "t:a" and got["r3"] == "t:c" and got["r4"] == "r:r4"


def test_percentiles_by_three_rules(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4, 10)] + [("b", 7)], "k string, v int")
    got = {x["k"]: x for x in C.percentiles(df, "v", ["k"]).collect()}
    assert (got["a"]["nearest_50"], got["a"]["rounded_50"], got["a"]["linear_50"], got["a"]["nearest_90"], round(got["a"]["linear_90"], 9)) == (3, 3, 3, 10, 7.6)
    assert got["b"]["nearest_50"] == got["b"]["linear_90"] == 7


def test_merge_keeps_what_is_not_overwritten(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "id int, v string, w string")
    assert sorted(map(tuple, R.merge_into(old, new, "id", ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(["x", "b", "a"], ["a", "b"])], "retrieved array<string>, gold array<string>")
    got = E.metrics_a(E.case_metrics(E.flagged(df))).first()
    assert (got["recall_at_k"], got["mrr"], got["evidence_recall"]) == (1.0, 0.5, 1.0)


def test_large_copy(spark):
    a = spark.createDataFrame([(1, "q" * 7 + "the quick brown fox jumps over the lazy dog and runs far away" + "z" * 9), (2, "short"), (3, None)], "answer_id long, answer string")
    e = spark.createDataFrame([(9, "0123456789 the quick brown fox jumps over the lazy dog and runs far off"), (8, "nothing of the kind is here, nothing of the kind at all")], "evidence_id long, evidence string")
    assert [tuple(r) for r in E.large_copies(a, e).collect()] == [(1, 9)]


def test_long_session(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(100)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert M.compression(m).first()["compress"] is True
    assert [r["turn"] for r in M.recent(m).orderBy("turn").collect()] == list(range(88, 100))
    assert len(M.memory(m).first()["memory"]) <= 1800
    pick = spark.createDataFrame([(1, 0, "assistant", "1. alpha\n2. beta"), (1, 1, "user", "number 2 please")], m.schema)
    assert M.selections(pick).first()["picked"] == "beta"


def test_urls(spark):
    f = lambda c: X.url_allowed(c, denied=["bad.org"])
    assert [one(spark, u, f) for u in ("https://a.example.com/x", "http://10.0.0.1/", "ftp://a.com", "https://u:p@a.com/", "http://sub.bad.org/")] == [True, False, False, False, False]


def test_denoised_lines(spark):
    x = one(spark, "Hello  world\nhello world\n----\nAb\nGood line here", X.denoised)
    assert (x["text"], x["n_lines"], x["n_repeated"], x["n_noise"]) == ("Hello world\nGood line here", 5, 1, 2)


def test_verification_join_counts_all_terms(spark, tmp_path):
    import re

    from quern.plans import catalogue

    passages = [(0, "the cat sat on the mat"), (1, "\u65b0\u95fb\u62a5\u9053 today"), (2, "ox"), (3, "responsibility alone here"), (4, "zebra quartz")]
    docs = [(10, "a cat sat there"), (11, "the responsibility"), (12, "\u65b0\u95fb\u62a5"), (13, "alone and here"), (14, None)]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def terms(t):
        run = re.sub(r"[^\u4e00-\u9fff]", "", t or "")
        return set(re.findall(r"[a-z0-9]{3,}", (t or "").lower())) | {run[i : i + n] for n in range(2, 7) for i in range(len(run) - n + 1)}

    want = set()
    for i, t in passages:
        n, j = max(((len(terms(t) & terms(u)), -j) for j, u in docs), default=(0, 0))
        status = "low_signal" if len(terms(t)) < 2 else "unverified" if not n else "station_matched" if n >= 2 else "conflict"
        want.add((i, -j if n else None, n, status))
    got = catalogue.queries()["verification_join"](spark, str(tmp_path)).select("left_id", "right_id", "shared", "status").collect()
    assert set(map(tuple, got)) == want


def test_near_duplicates_in_two_passes(spark, tmp_path):
    from difflib import SequenceMatcher

    from quern.plans import catalogue

    body = "the council met in the old hall and spoke of roads, schools and the new bridge over the river " * 8
    day = 4000  # ids so far apart have the same day
    texts = ["Alpha news\n" + body, "Zulu wire\n" + body, "Alpha news\n" + body[:400] + "x" * 500, "Alpha news\n" + "quite another story " * 30, "Alpha news\n" + body, "Mike\nnothing like it"]
    rows = [(i * day, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1, texts[0] + "!", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ratio = lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio()
    want, block = set(), [r for r in rows if r[0] % day == 0]
    for value, order, least in ((lambda t: t.split("\n")[0],) * 2 + (0.9,), (lambda t: " ".join(t.split())[:1000], lambda t: " ".join(t.split())[:200], 0.95)):
        placed = sorted(block, key=lambda r: (order(r[1]), r[0]))
        want |= {tuple(sorted((x[0], y[0]))) for i, x in enumerate(placed) for y in placed[i + 1 : i + 5] if x[1] != y[1] and ratio(value(x[1]), value(y[1])) >= least}
    got = [(r["a"], r["b"]) for r in catalogue.queries()["near_dup_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (0, day) in want and (0, 3 * day) in want


def test_numbers_and_sums_of_hot_keys(spark):
    r = random.Random(3)
    rows = [(r.choice(("a", "a", "a", "b", None)), r.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    got = {x["id"]: (x["n"], x["s"]) for x in R.running_sum(R.numbered(df, ["k"], ["v", "id"], "n"), ["k"], ["v", "id"], "v", "s").collect()}
    want, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda x: (x[1], x[2])):
        n, s = seen.get(k, (0, 0))
        seen[k] = want[i] = (n + 1, s + v)
    assert got == want


def test_containment_of_passages_of_any_length(spark):
    r = random.Random(12)
    text = lambda n: "".join(r.choice("ab é") for _ in range(n))
    texts = [text(r.randint(0, 120)) for _ in range(60)] + ["", None]
    passages = [text(n) for n in (1, 2, 3, 4, 5, 7, 9, 15, 17, 40)] + ["", None] + [t[k : k + n] for t, k, n in zip(texts[:20], range(20), (3, 8, 16, 20, 33) * 4)]
    a, b = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(p,) for p in passages], "p string")
    got = sorted(map(tuple, E.containing(a, "t", b, "p").collect()))
    assert got == sorted({(t, p) for t in texts for p in passages if t is not None and p is not None and p in t})
    assert E.containing(a, "t", b.limit(0), "p").count() == 0


def test_garbled_texts(spark):
    values = ["fine words here", "bad \ufffd sign", "\x01\x02\x03" + "a" * 20, "\x01" + "a" * 200, "1234567890 " * 6, "12 34", "\u65b0\u95fb" + " 12" * 30, "", None]
    assert [one(spark, v, X.garbled) for v in values] == [False, True, True, False, True, False, False, False, False]


def test_visible_text_decodes_all_references(spark):
    page = "<p>a &eacute;&#233;&#xe9; &lt;b&gt; &hellip;</p><script>x</script><p>c &#99999999999;</p>"
    assert one(spark, page, X.visible_text) == "a \u00e9\u00e9\u00e9 <b> \u2026\nc \ufffd"
    assert one(spark, page, lambda c: X.visible_text(c, " ", hidden=())) == "a \u00e9\u00e9\u00e9 <b> \u2026 x c \ufffd"


def test_hints_come_from_earlier_turns(spark):
    m = spark.createDataFrame([(1, 0, "user", "of rates"), (1, 1, "assistant", "banks"), (1, 2, "user", "this one"), (1, 4, "user", "and it, banks")], "conv_id long, turn long, role string, text string")
    got = M.follow_ups(m, ["it", "this"], r"(?i)\b(it|this)\b", M.hints(m, ["rates", "banks"])).orderBy("turn").collect()
    assert [(r["turn"], r["query"]) for r in got] == [(2, "rates this one"), (4, "rates and , banks")]


def test_keyword_channel_is_the_filter_for_each_query(spark):
    r = random.Random(1)
    docs = [(i, f"s{i % 3}", r.randrange(40), " ".join(r.sample(["bank", "rate", "gold", "none"], 2))) for i in range(200)]
    n = spark.createDataFrame(docs, "doc_id int, source string, publish_ts int, title string")
    asked = [(1000, ["bank", "gold"], None), (1001, ["rate"], "s1"), (1002, [], None)]
    got = {}
    for x in K.keyword_channel(spark.createDataFrame(asked, "query_id int, terms array<string>, source string"), n, "title", ["bank", "rate", "gold"], limit=7).orderBy("pos").collect():
        got.setdefault(x["query_id"], []).append(x["doc_id"])
    for q, terms, source in asked:
        must = {"source": source} if source else {}
        assert got.get(q, []) == [x["doc_id"] for x in K.must_should(n, must, "title", terms, limit=7).collect()]


def test_carried_evidence(spark):
    from quern.operators import ranking as K

    asked = spark.sql("SELECT 1L AS query_id, array(5L, 6L, 5L, null, 99L) AS ids UNION ALL SELECT 2L, null")
    chunks = spark.sql("SELECT * FROM VALUES (5L, 'body', 0, 3.0D), (5L, 'summary', 0, null), (5L, 'body', 1, 9.0D), (6L, 'body', 0, 0.5D) AS t(doc_id, chunk_type, chunk_index, score)")
    got = sorted((r["pos"], r["doc_id"], r["chunk_type"], r["score"]) for r in K.carried(asked, chunks).collect())
    assert got == [(0, 5, "body", 3.0), (0, 5, "summary", 1.0), (1, 6, "body", 1.0)]
    assert sorted(r["doc_id"] for r in K.carried(asked, chunks, most=1).collect()) == [5, 5]


def test_coverage_and_gates(spark):
    from pyspark.sql import functions as F

    from quern.operators import evaluation as E

    cases = spark.sql("SELECT * FROM VALUES ('a'), ('a'), (null) AS t(kind)")
    got = {r["scenario"]: (r["n"], r["required"], r["missing"]) for r in E.scenario_coverage(cases, "kind", ["a", "b"]).collect()}
    assert got == {"a": (2, True, False), "": (1, False, False), "b": (0, True, True)}
    samples = spark.sql("SELECT * FROM VALUES ('x', 'u'), (null, 'u'), (' ', null), ('y', 'v') AS t(text, source)")
    one = E.completeness(samples, ["text", "source"], {"u_rate": F.coalesce(F.col("source") == "u", F.lit(False))}, F.lit(False), source="source")
    assert tuple(one.first()) == (4, 2, 0.625, 0.5, 0)
    assert {r["condition"]: r["passed"] for r in E.gated(one, {"samples": 4, "u_rate": 0.6}, {"errors": 0}).collect()} == {"samples_at_least": True, "u_rate_at_least": False, "errors_at_most": True, "ready": False}
    none = E.completeness(samples.limit(0), ["text"], {"u_rate": F.lit(True)}, F.lit(False), source="source").first()
    assert tuple(none) == (0, 0, 0.0, 0.0, 0)


def test_keyword_gold(spark):
    from quern.operators import evaluation as E

    cases = spark.sql("SELECT * FROM VALUES (1, array('Rate', 'x')), (2, array('zz', '')), (3, null) AS t(id, words)")
    docs = spark.sql("SELECT * FROM VALUES (7, 'the RATE rose'), (8, 'axe'), (9, null), (10, 'the rate rose') AS t(doc, title)")
    assert sorted(map(tuple, E.keyword_gold(cases, docs, "id", "words", "title", "doc").collect())) == [(1, 7), (1, 8), (1, 10)]
