"""Evaluation texts leaking into training text: Wu-Manber search over words.

Patterns are all windows of ``MIN_WORDS`` words of the evaluation items.  A
table of shifts over blocks of two words says how far the end of the search
window may move without passing an occurrence; where it says 0, the bucket
of the window's suffix hash gives the patterns to try, and direct comparison
confirms.  Each document is read once per block of
patterns; nothing is shuffled but the matches.

The tables are arrays, built once for a block of patterns and loaded once by a
worker process: about 16 bytes a pattern, 4 a word of the items and the words'
dictionary.  Items are split into blocks by hash; the driver holds one block at
a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.runtime import stash
from twinloom.sources.tables import table

MIN_WORDS = 13
#: Patterns searched for in one pass; more are searched in further passes.
PATTERNS_A_PASS = 1_000_000
_SHIFT_BITS = 22
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Search for many word windows of one length (2 or more) at once; words are numbered, so equal numbers are equal words."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], m: int = MIN_WORDS):
        self.m, self.known = m, {}
        text, owner, start = array("i"), array("i"), array("i")
        self.items: list[int] = []
        for i, ws in items:
            if len(ws) >= m:
                start.extend(range(len(text), len(text) + len(ws) - m + 1))
                owner.extend([len(self.items)] * (len(ws) - m + 1))
                self.items.append(i)
                text.extend(self.known.setdefault(w, len(self.known)) for w in ws)
        ids, begin, own = (np.frombuffer(x, np.int32).astype(np.int64) if len(x) else np.empty(0, np.int64) for x in (text, start, owner))
        shift = np.full(1 << _SHIFT_BITS, m - 1, np.uint8 if m < 256 else np.int32)
        for j in range(2, m + 1):  # the block of two words that ends j words into a window
            np.minimum.at(shift, self._slot(ids[begin + j - 2], ids[begin + j - 1]), shift.dtype.type(m - j))
        self.shift = shift.tobytes() if m < 256 else shift.tolist()
        key = np.zeros(len(begin), np.uint64)
        for j, r in enumerate(self._powers()):  # suffix hash over the whole window: a frequent last block fills no bucket
            key += ids[begin + j].astype(np.uint64) * np.uint64(r)
        order = np.argsort(key, kind="stable")
        self.keys, self.begin, self.own = key[order], begin[order].astype(np.int32), own[order].astype(np.int32)
        self.text = text.tobytes()

    def _powers(self) -> list[int]:
        return [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(self.m)]

    def _slot(self, a, b):
        return (a * 40_503 + b * 2_654_435_761 % (1 << 32)) & ((1 << _SHIFT_BITS) - 1)

    def find(self, text: list[str]) -> set[int]:
        """Items with a window in the text."""
        out: set[int] = set()
        shift, m, n, known, powers = self.shift, self.m, len(text), self.known, self._powers()
        ids = array("i", [known.get(w, -1) for w in text])
        raw, width, mask = None, ids.itemsize, (1 << _SHIFT_BITS) - 1
        end = m - 1
        while end < n:
            a, b = ids[end - 1], ids[end]
            if b < 0:  # in no pattern: the window may begin after it
                end += m
                continue
            if a < 0:
                end += m - 1
                continue
            step = shift[(a * 40_503 + b * 2_654_435_761 % (1 << 32)) & mask]
            if not step:
                at = end - m + 1
                window = ids[at : end + 1]
                key = np.uint64(sum(map(mul, window, powers)) & ((1 << 64) - 1)) if min(window) >= 0 else None
                k = len(self.keys) if key is None else int(np.searchsorted(self.keys, key))
                while k < len(self.keys) and self.keys[k] == key:
                    raw = ids.tobytes() if raw is None else raw
                    p = int(self.begin[k]) * width
                    if self.text[p : p + m * width] == raw[at * width : (end + 1) * width]:
                        out.add(self.items[self.own[k]])
                    k += 1
                step = 1
            end += step
        return out


def _blocks(items: DataFrame, min_words: int, patterns: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with their words in blocks by hash, of about ``patterns`` windows; repeated rows once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, ws) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if len(ws := words(t)) >= min_words]
            i, ws = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, b.column(0).type), pa.array(ws, pa.list_(pa.string()))], ["item_id", "words"])

    kind = dict(items.dtypes)["item_id"]
    known = stash(items.select("item_id", "text").where("item_id is not null and text is not null").mapInArrow(run, f"item_id {kind}, words array<string>").dropDuplicates(), "items")
    windows = known.agg(F.sum(F.size("words") - min_words + 1)).first()[0] or 0
    n = -(-windows // patterns)
    for i in range(n):
        yield [(r.item_id, r.words) for r in known.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == i).toLocalIterator()]


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, patterns_a_pass: int = PATTERNS_A_PASS) -> DataFrame:
    """``(doc_id, item_id)``: the document holds, without gap, at least ``min_words`` (2 or more) consecutive words of the item.

    Null or shorter texts match nothing on either side; repeated rows give one
    result row; other columns are ignored.  The items are the stated query set:
    they pass through the driver in blocks of about ``patterns_a_pass`` windows,
    and each block's tables are released before the next is built.
    """
    spark = docs.sparkSession
    ids = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    source = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = spark.createDataFrame([], f"doc_id {ids[0]}, item_id {ids[1]}")
    last = None
    for block in _blocks(items, min_words, patterns_a_pass):
        if last is not None:  # only the last pass is left to be run with the result
            shared, found = last
            out = out.unionByName(stash(found, "leaks"))
            shared.destroy()
        shared = spark.sparkContext.broadcast(WuManber(block, min_words))
        last = shared, _search(source, shared, *ids)
    return (out if last is None else out.unionByName(last[1])).distinct()


def _search(source: DataFrame, shared, doc_type: str, item_type: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        finder = shared.value  # loaded once by each worker process
        for b in batches:
            hits = [(d, i) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in finder.find(words(t))]
            d, i = zip(*hits, strict=True) if hits else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, b.column(0).type), pa.array(i, pa.int64())], ["doc_id", "item_id"])

    return source.mapInArrow(run, f"doc_id {doc_type}, item_id bigint").withColumn("item_id", F.col("item_id").cast(item_type))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
