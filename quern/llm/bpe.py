"""BPE encoding and decoding: merge ranks in a priority queue over a doubly linked symbol list.

The vocabulary file says how texts are split: special tokens first, then NFC, white space as one
space, lower case, and the words of one pattern; each word is merged on its own. No word holds white
space, so a text's white-space-delimited runs are encoded one by one and remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs that are remembered: none longer, and no more than so many, twice over.
RUN_CHARS, RUNS = 48, 500_000
#: White space as the vocabulary's patterns have it; split() knows four more, x1C to x1F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


#: Letters and numbers that Unicode 16 has added to Python's 15.1.
ADDED = {
    "L": "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}


@lru_cache(maxsize=4)
def ranges(major: str) -> str:
    """The characters of a general category's major class, as the inside of a pattern's brackets."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    out += ["-".join(f"\\U{int(x, 16):08x}" for x in pair.split("-")) for pair in ADDED[major].split()]
    return "".join(out)


class Runs(dict):
    """Ids by run: two generations, the older dropped when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, run: str) -> bytes:
        made = self.old.get(run)
        if made is None:
            made = self.make(run)
        if len(run) <= RUN_CHARS:
            if len(self) >= RUNS:
                self.old = dict(self)
                self.clear()
            self[run] = made
        return made


class WordBPE:
    """Encoder and decoder of a vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in steps if p["type"] == "Split")
        self.words = re.compile(pattern.replace(r"\p{L}", ranges("L")).replace(r"\p{N}", ranges("N")).replace(r"\s", WHITE))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.white = re.compile(f"[{WHITE}]+")
        self.make = self.word
        self.runs = Runs(self.run)

    def merge(self, word: str) -> list[int]:
        """Ids of one word. Queue entries hold rank, position and result; an entry whose pair has since changed is stale and skipped."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n, ranks = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, found[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (found := ranks(pair))]
        heapify(queue)
        while queue:
            _, i, made = heappop(queue)
            if (j := after[i]) >= n or ids[i] < 0 or (now := ranks((ids[i], ids[j]))) is None or now[1] != made:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks((made, ids[k])):
                    heappush(queue, (found[0], i, found[1]))
            if (p := before[i]) >= 0 and (found := ranks((ids[p], made))):
                heappush(queue, (found[0], p, found[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        ids = self.merge(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, run: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a run without white space; its words are runs as well."""
        words = [run] if run.isascii() and run.isalpha() else self.words.findall(run)
        if len(words) == 1 and words[0] == run:
            return self.make(run)
        return b"".join([self.runs[w] for w in words])

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # one small sigma, at word ends too
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            parts = [p for p in self.white.split(text) if p]
        else:
            parts = text.split()
        runs = self.runs
        return b"".join([runs[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self.plain(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self.plain(p) for p in self.split.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings, joined as a vocabulary without a decoder has it: by spaces."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBPE:
    """One encoder for each Python worker."""
    return WordBPE(path)


def encode_decode(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit), decoded: one row per row of docs. Null texts count as empty; empty texts have no ids; rows that repeat stay; an empty table gives none; other columns don't matter. No row sees another, so nothing is shuffled."""
    common.prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(each, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_decode gives, digested where it is made, with the same results for nulls, empty texts, repeated rows and an empty table."""
    common.prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            n, one, two = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), common.tokenizer_path())
