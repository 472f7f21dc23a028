"""Substring dedup: suffix automata of reference shards, matching statistics, spans that occurred before.

The reference is the corpus itself, so it is first cut down to what can repeat. Each window of words is
named by its least gram (a minimizer): equal windows have equal names. Consecutive windows of one name
are a segment, and segments whose name occurs once leave. What stays is sharded by name, so that all
places of a window are in one shard, and equal segments are one content with its earliest place.
A shard's contents make a suffix automaton over words; its states know the earliest place at which
their words end. The contents are streamed through it: where the matching statistic reaches the
threshold, the window's earliest place is read from the state. Every occurrence of a content is then
judged by its own place, and the maximal spans of windows that started earlier leave the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window, and of the grams that name it.
WINDOW, GRAM = 20, 6
#: Words of a reference shard, and contents of one name above which its windows are named one by one.
SHARD_WORDS, NAME_CONTENTS = 150_000, 4000
#: Names of so many contents that are broadcast at most (8 MB); more are joined by key.
BROADCAST_NAMES = 1_000_000
#: Odd multiplier of the grams' hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


def least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each window of so many, and the leftmost place that has it."""
    v, at, has = values, np.arange(len(values)), 1
    while has < width:
        step = min(has, width - has)
        a, b = v[:-step], v[step:]
        left = a <= b
        v, at, has = np.where(left, a, b), np.where(left, at[:-step], at[step:]), has + step
    return v, at


class Runs:
    """The runs of windows with one name in some texts: value, text (its number), start (its first word in the text), windows, several (whether the name is at more places than one of the run)."""

    def __init__(self, texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        ends = sizes.cumsum()
        n = int(sizes.sum())
        hashes = np.fromiter((x for w in self.words for x in map(xxhash.xxh3_64_intdigest, w)), dtype=np.uint64, count=n)
        text = np.repeat(np.arange(len(sizes)), sizes)
        if n < window:
            self.value, self.text, self.start, self.windows, self.several = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
            return
        grams = np.zeros(n - gram + 1, dtype=np.uint64)
        for k in range(gram):
            grams = grams * FACTOR + hashes[k : n - gram + 1 + k]
        value, at = least(common.mixed(grams), window - gram + 1)
        inside = np.flatnonzero(text[: len(value)] == text[window - 1 :])  # windows within one text
        value, at, text = value[inside], at[inside], text[inside]
        fresh = np.ones(len(inside), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(inside)) - 1
        self.value, self.text = value[first], text[first]
        self.start = inside[first] - (ends - sizes)[self.text]
        self.windows = last - first + 1
        self.several = at[first] != at[last] if len(first) else np.zeros(0, bool)
        starts = np.flatnonzero(np.diff(self.text, prepend=-1))
        self.number = np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))  # of the run in its text


def names(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """_to, _doc, _run, _runs: names of runs. A name that repeats within an Arrow batch needs no others: its runs come by document in _runs, under a _to that only spreads them, and its name once, without a run. So a name that all documents hold gives a row a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, r = b.column(0).to_numpy(zero_copy_only=False), Runs(b.column(1).to_pylist(), window, gram)
            if not len(r.value):
                continue
            value = r.value.view(np.int64)
            unique, inverse, n = np.unique(value, return_inverse=True, return_counts=True)
            known = (n[inverse] > 1) | r.several
            told = np.unique(value[known])
            one = ~known
            k = np.flatnonzero(known)
            at = np.flatnonzero(np.diff(r.text[k], prepend=-1))
            packed = [x.astype("<i4").tobytes() for x in np.split(r.number[k], at[1:])] if len(k) else []
            owner = doc[r.text[k][at]] if len(k) else np.zeros(0, np.int64)
            to = np.concatenate([value[one], told, common.mixed(owner.view(np.uint64) + FACTOR).view(np.int64)])
            docs_ = np.concatenate([doc[r.text[one]], np.full(len(told), NO_ID), owner])
            run = np.concatenate([r.number[one], np.full(len(told) + len(owner), -1)])
            runs = pa.array([None] * (len(to) - len(packed)) + packed, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(docs_, pa.int64()), pa.array(run, pa.int32()), runs], names=["_to", "_doc", "_run", "_runs"])

    return docs.select("_doc", "text").mapInArrow(each, "_to long, _doc long, _run int, _runs binary")


def marks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """_doc, _one, _many: numbers of runs whose name is at several places of the corpus (of rows with one id: those of any)."""
    found = names(docs, window, gram).withColumn("_n", F.count("*").over(Window.partitionBy("_to")))  # a row a batch for each name at most
    found = found.filter("_runs IS NOT NULL OR (_n > 1 AND _run >= 0)")
    return found.groupBy("_doc").agg(F.collect_set(F.when(F.col("_runs").isNull(), F.col("_run"))).alias("_one"), F.collect_list("_runs").alias("_many"))


SEGMENTS = "_key long, _h long, _doc long, _row long, _start int, _words string"


def segments(docs: DataFrame, marked: DataFrame, window: int, gram: int) -> DataFrame:
    """SEGMENTS of the marked runs: _key is the name, _h a hash of the words, _start the first word's place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            r = Runs(b.column(2).to_pylist(), window, gram)
            if not len(r.value):
                continue
            keep = np.zeros(len(r.value), dtype=bool)
            first = np.searchsorted(r.text, np.arange(len(doc) + 1))
            for i, (one, many) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                at = np.concatenate([np.array(one, dtype=np.int64), *(np.frombuffer(x, "<i4") for x in many)])
                keep[first[i] + at[at < first[i + 1] - first[i]].astype(np.int64)] = True
            k = np.flatnonzero(keep)
            words = [b" ".join(r.words[t][s : s + n]) for t, s, n in zip(r.text[k].tolist(), r.start[k].tolist(), (r.windows[k] + window - 1).tolist(), strict=True)]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(k)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.value[k].view(np.int64)), pa.array(h), pa.array(doc[r.text[k]]), pa.array(row[r.text[k]]), pa.array(r.start[k], pa.int32()), pa.array(words, pa.binary()).cast(pa.string())],
                names=["_key", "_h", "_doc", "_row", "_start", "_words"],
            )

    return docs.join(marked, "_doc").select("_doc", "_row", "text", "_one", "_many").mapInArrow(each, SEGMENTS)


def contents(found: DataFrame) -> DataFrame:
    """_key, _h, _doc, _start, _words: the distinct segments with their earliest places."""
    told = found.groupBy("_key", "_h").agg(F.min(F.struct("_doc", "_start", "_words")).alias("_m"))
    return told.select("_key", "_h", "_m._doc", "_m._start", "_m._words")


def window_by_window(found: DataFrame, window: int) -> DataFrame:
    """Each window of the segments as a segment of its own, named by all its words."""
    words = F.split("_words", " ")
    cut = F.transform(F.sequence(F.lit(0), F.size("_w") - window), lambda k: F.struct((F.col("_start") + k).alias("_start"), F.array_join(F.slice("_w", k + 1, window), " ").alias("_words")))  # a long segment's words are copied a window at a time
    each = found.select("_doc", "_row", "_start", words.alias("_w")).select("_doc", "_row", F.explode(cut).alias("_c")).select("_doc", "_row", "_c.*")
    return each.select(F.xxhash64("_words").alias("_key"), F.xxhash64(F.lit(7), "_words").alias("_h"), "_doc", "_row", "_start", "_words")


class Automaton:
    """Suffix automaton of several sequences. A state's place is the earliest at which one of its words' occurrences ends."""

    def __init__(self):
        self.to: list[dict[int, int]] = [{}]
        self.link, self.size, self.place = [-1], [0], [1 << 62]

    def add(self, sequence: list[int], place: int) -> None:
        """place: of its first symbol; the others follow."""
        to, link, size, at, last = self.to, self.link, self.size, self.place, 0
        for c in sequence:
            q = to[last].get(c, -1)
            if q >= 0 and size[q] == size[last] + 1:
                last = q
                if place < at[q]:
                    at[q] = place
                place += 1
                continue
            new = len(to)
            if q < 0:
                to.append({})
                size.append(size[last] + 1)
                link.append(0)
                at.append(place)
                p = last
                while p >= 0 and (q := to[p].get(c, -1)) < 0:
                    to[p][c] = new
                    p = link[p]
                last = new
                if p >= 0:
                    link[new] = q if size[q] == size[p] + 1 else self._parted(p, q, c)
            else:
                last = self._parted(last, q, c)
                if place < at[last]:
                    at[last] = place
            place += 1

    def _parted(self, p: int, q: int, c: int) -> int:
        """The state of q's words that are reached from p, parted from its longer ones."""
        to, link, clone = self.to, self.link, len(self.to)
        to.append(dict(to[q]))
        self.size.append(self.size[p] + 1)
        link.append(link[q])
        self.place.append(self.place[q])
        link[q] = clone
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = clone
            p = link[p]
        return clone

    def settle(self) -> None:
        """Places of longer words are places of their suffixes."""
        link, at = self.link, self.place
        for v in np.argsort(-np.array(self.size), kind="stable").tolist():
            if (u := link[v]) > 0 and at[v] < at[u]:
                at[u] = at[v]

    def statistics(self, sequence: list[int], least_words: int) -> tuple[list[int], list[int]]:
        """Of each symbol the matching statistic (the longest suffix up to it that the reference holds, counted up to least_words) and, where it is so long, the earliest place at which those words end, else -1."""
        to, link, size, at = self.to, self.link, self.size, self.place
        v = n = 0
        lengths, places = [], []
        for c in sequence:
            while (u := to[v].get(c, -1)) < 0 and v:
                v = link[v]
                n = size[v]
            if u >= 0:
                v, n = u, n + 1
            if n >= least_words:
                while size[link[v]] >= least_words:
                    v = link[v]
                n = least_words
                places.append(at[v])
            else:
                places.append(-1)
            lengths.append(n)
        return lengths, places


SPANS = "_key long, _h long, _at array<int>, _n array<int>, _edoc array<long>, _estart array<int>"


def matched(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """SPANS of a shard's contents: from window _at on, _n windows occur earliest at document _edoc from word _estart on."""
    rows = rows.sort_values(["_doc", "_start"], kind="stable")
    docs, rank = np.unique(rows["_doc"].to_numpy(), return_inverse=True)
    ids: dict[str, int] = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in t.split(" ")] for t in rows["_words"]]
    reference = Automaton()
    for s, place in zip(sequences, ((rank.astype(np.int64) << 32) + rows["_start"].to_numpy()).tolist(), strict=True):
        reference.add(s, place)
    reference.settle()
    out = []
    for key, h, s in zip(rows["_key"].tolist(), rows["_h"].tolist(), sequences, strict=True):
        places = np.array(reference.statistics(s, window)[1][window - 1 :], dtype=np.int64)
        at = np.flatnonzero(np.diff(places, prepend=places[0]) != 1)  # where another place, or the first one, goes on
        n = np.diff(np.append(at, len(places)))
        out.append((key, h, at.astype(np.int32), n.astype(np.int32), docs[places[at] >> 32], ((places[at] & 0xFFFFFFFF) - window + 1).astype(np.int32)))
    return pd.DataFrame(out, columns=["_key", "_h", "_at", "_n", "_edoc", "_estart"])


def repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, name_contents: int = NAME_CONTENTS) -> DataFrame:
    """_doc, _row, _gone: for each of docs (_doc, _row, text) that has windows which started earlier, its spans: n of them in a row from word s on are s * 2 ** 32 + n."""
    docs = docs.select("_doc", "_row", "text")
    found = common.materialize(segments(docs, marks(docs, window, gram), window, gram), "segments")
    size = F.char_length("_words") - F.char_length(F.replace("_words", F.lit(" "))) + 1
    names = found.groupBy("_key", "_h").agg(F.max(size).alias("_w")).groupBy("_key").agg(F.count("*").alias("_contents"), F.sum("_w").alias("_w"))  # without texts
    names = common.materialize(names, "names")
    many = names.filter(F.col("_contents") > name_contents).select("_key")
    words = names.filter(F.col("_contents") <= name_contents).agg(F.sum("_w")).first()[0] or 0
    held = contents(found)
    if n := many.count():  # their segments alone are cut anew
        many = F.broadcast(many) if n <= BROADCAST_NAMES else many  # else segments of a frequent name would meet in one task
        cut = common.materialize(window_by_window(found.join(many, "_key", "left_semi"), window), "windows")
        rest = found.join(many, "_key", "left_anti")
        held, found = contents(rest).unionByName(contents(cut)), rest.unionByName(cut)
        words += window * cut.count()
    shards = max(1, -(-words // shard_words))
    parts = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.sparkSession.sparkContext.defaultParallelism))
    sharded = held.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards))).repartition(parts, "_shard")
    spans = common.materialize(sharded.groupBy("_shard").applyInPandas(lambda rows: matched(rows, window), SPANS), "spans")
    judged = found.select("_key", "_h", "_doc", "_row", "_start").join(spans, ["_key", "_h"])
    zipped = F.arrays_zip("_at", "_n", "_edoc", "_estart")
    before = lambda x: (x["_edoc"] < F.col("_doc")) | ((x["_edoc"] == F.col("_doc")) & (x["_estart"] < F.col("_start") + x["_at"]))
    gone = F.transform(F.filter(zipped, before), lambda x: F.shiftleft((F.col("_start") + x["_at"]).cast("long"), 32) + x["_n"])
    return judged.select("_doc", "_row", F.explode(gone).alias("_span")).groupBy("_doc", "_row").agg(F.collect_list("_span").alias("_gone"))


def without(text: str | None, gone: list | None, window: int) -> tuple[str, int, int]:
    """The words that no span covers, joined by a space; the number of all words and of those removed."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if gone is not None and len(gone):
        keep = np.ones(n, dtype=bool)
        for x in gone:
            keep[x >> 32 : (x >> 32) + (x & 0xFFFFFFFF) + window - 1] = False
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)


def dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, name_contents: int = NAME_CONTENTS) -> DataFrame:
    """The columns of docs, with _text (the words that stay, joined by a space), _n_words and _n_removed.

    A word leaves if a window of words covers it that starts earlier too: in a smaller doc_id, or in the same one at a smaller place. Null ids come before all others. Null and empty texts, and texts shorter than a window, lose nothing. Rows that repeat stay: rows of one id are places of that id, so that equal rows are not earlier than each other. An empty table gives none; columns with a name that is used here give way."""
    docs = common.giving_way(docs, "_text", "_n_words", "_n_removed", "_doc", "_row", "_gone", "_kept")
    tagged = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_row": F.xxhash64(F.coalesce("text", F.lit("")))})
    gone = repeats(tagged, window=window, gram=gram, shard_words=shard_words, name_contents=name_contents)

    @F.pandas_udf("struct<text: string, n: long, gone: long>")
    def applied(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without(t, g, window) for t, g in zip(texts, spans, strict=True)], columns=["text", "n", "gone"])

    joined = tagged.join(gone, ["_doc", "_row"], "left").withColumn("_kept", applied("text", "_gone"))
    return joined.select(*docs.columns, F.col("_kept.text").alias("_text"), F.col("_kept.n").alias("_n_words"), F.col("_kept.gone").alias("_n_removed"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup() of documents; the digest is of the kept text."""
    done = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM windows),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM hashed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
single AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT s.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(s.word, ' ' ORDER BY s.i) FILTER (WHERE g.i IS NULL) AS t
  FROM single s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
