"""Garbled text from wrong character encoding: n-gram models over decode chains.

Only blank-separated words with a non-ASCII character can show a wrong
decoding, so those words are taken out of every document once.  Character
trigram models with smoothing are trained on the words of clean records (no
replacement or C1 control character, no word that is itself valid UTF-8 read in
a one-byte encoding, unless that reading has a rarer character than the word).  Text that went from one one-byte encoding to another
still passes as clean then, so the words that this first model already finds
garbled are left out and the model is trained again.  Each word is scored
against every candidate chain "encode as it was wrongly decoded, decode as it
should have been", and the likeliest is accepted where its log-likelihood beats
the stored word's by a margin.  The margin is validated on clean records held
out of training: their words as stored must not be changed, and the same words
garbled on purpose must be found.  Training and scoring run over the distinct
words with their counts, so that each word is scored once for all documents.

The counts are kept in ``2**20`` hash slots for each order, so the model's size
is bounded whatever the alphabet; all records are counted.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.runtime import stash
from twinloom.sources.tables import table

#: One-byte encodings text may have been read in by mistake, and those it may have been written in.
WRONG = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_15", "cp1253", "koi8_r")
RIGHT = ("cp1252", "cp850", "mac_roman", "cp437")
#: Log-prior against a text written in another encoding than UTF-8 or the common one-byte one.
RARE_RIGHT = 8.0
DEPTH = 3  # times a text may have been garbled through UTF-8
HELD_OUT = 10  # one clean record in so many is kept for validation
FALSE_COST = 20.0  # a changed clean word weighs as many missed garbled words
FIRST_MARGIN = 3.0  # gain from which the first model leaves a word out of the second's training
_SLOTS = 1 << 20
_START, _END = "\x02", "\x03"
_BIN = 0.5


def suspects(text: str | None) -> list[str]:
    """Blank-separated words with a non-ASCII character."""
    if not text or text.isascii():
        return []
    return [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if not w.isascii()]


def _tables() -> dict[str, tuple[dict[int, int], dict[int, int]]]:
    """Per encoding: code point to byte and byte to code point; bytes without a character stand for themselves, as lenient readers have it."""
    out = {}
    for e in {*WRONG, *RIGHT}:
        back = {}
        for b in range(256):
            try:
                back[b] = ord(bytes([b]).decode(e))
            except UnicodeDecodeError:
                back[b] = b
        out[e] = ({c: b for b, c in back.items()}, back)
    return out


_TABLES = _tables()
#: Per pair of one-byte encodings: code point to code point.
_CROSS = {(x, y): {c: _TABLES[y][1][b] for c, b in _TABLES[x][0].items()} for x in WRONG for y in RIGHT if x != y}


def encode(word: str, encoding: str) -> bytes | None:
    there = _TABLES[encoding][0]
    try:
        return bytes([there[ord(c)] for c in word])
    except KeyError:
        return None


def decode(raw: bytes, encoding: str) -> str:
    back = _TABLES[encoding][1]
    return "".join([chr(back[b]) for b in raw])


_STORED = re.compile(r"[^ \n\t\r]+")  # words as suspects() cuts them
_RUN = re.compile(r"[^\x00-\x7f]+")


def _decoded(run: str, encoding: str) -> str | None:
    raw = encode(run, encoding)
    try:
        return None if raw is None else raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _utf8(word: str) -> Iterator[tuple[str, str]]:
    """The word's readings as UTF-8 in one-byte encodings; where a character was lost, of those runs that still are valid."""
    runs = _RUN.findall(word)
    if all(len(r) == 1 for r in runs):  # one byte alone is never valid
        return
    for e in WRONG:
        read = [_decoded(r, e) for r in runs]
        if any(x is not None for x in read):
            left = iter(zip(runs, read, strict=True))
            yield e, _RUN.sub(lambda _, left=left: next(r if x is None else x for r, x in [next(left)]), word)


def chains(word: str) -> dict[tuple[str, ...], str]:
    """Every other reading of the word, by the chain that gives it."""
    out: dict[tuple[str, ...], str] = {}
    seen, level = {word}, [((), word)]
    for _ in range(DEPTH):
        deeper = []
        for chain, w in level:
            for e, r in _utf8(w):
                if r not in seen:
                    seen.add(r)
                    out[(*chain, e, "utf-8")] = r
                    if not r.isascii():
                        deeper.append(((*chain, e, "utf-8"), r))
        level = deeper
    odd = {ord(c) for c in word if not c.isascii()}  # ASCII is the same in all of them
    for x in WRONG:
        if odd <= _TABLES[x][0].keys():
            for y in RIGHT:
                if x != y and (r := word.translate(_CROSS[x, y])) not in seen:
                    seen.add(r)
                    out[x, y] = r
    return out


def garble(word: str) -> dict[tuple[str, ...], str]:
    """The word as wrong decodings leave it, by the chain that restores it."""
    out = {}
    for e in WRONG:
        raw = word.encode("utf-8", "replace")
        out[e, "utf-8"] = decode(raw, e)
    for y in RIGHT:
        raw = encode(word, y)
        if raw is not None:
            for x in WRONG:
                if x != y:
                    out[x, y] = decode(raw, x)
    return {k: v for k, v in out.items() if v != word}


def is_lossy(word: str) -> bool:
    """Holds the replacement character: something could not be decoded."""
    return "�" in word


def looks_clean(word: str, common: dict[str, int]) -> bool:
    """Fit for training: no lost or control character, and no reading as UTF-8 whose rarest character is as ``common`` as the word's (``l’été`` can be read as UTF-8 too, but with an Armenian letter)."""
    if is_lossy(word) or any("\x80" <= c <= "\x9f" for c in word):
        return False
    rarest = lambda w: min((common.get(c, 0) for c in w if not c.isascii()), default=0)
    own = rarest(word)
    return not any(rarest(r) >= own for _, r in _utf8(word))


def _slot(order: int, gram: str) -> int:
    return order * _SLOTS + zlib.crc32(gram.encode("utf-8", "surrogatepass")) % _SLOTS


def counts_array(items: Iterable[tuple[int, int]]) -> array:
    """Counts by slot, and their total at the end: 8 * (3 * 2**20 + 1) bytes whatever the corpus."""
    out = array("q", bytes(8 * (3 * _SLOTS + 1)))
    for slot, n in items:
        out[slot] = n  # slot -1 is the last
    return out


class Model:
    """Smoothed character trigram model over hashed counts (interpolated with bigrams and unigrams)."""

    def __init__(self, counts: dict[int, int] | array, weight: float = 4.0):
        self.counts, self.weight = counts if isinstance(counts, array) else counts_array(counts.items()), weight
        self.total = self.counts[-1]
        self.known: dict[str, float] = {}

    def count(self, gram: str) -> int:
        """At most the counts of the gram's parts, so that a gram with an unseen character has none from a shared slot."""
        n = self.counts[_slot(len(gram) - 1, gram)]
        return min(n, self.count(gram[1:]), self.count(gram[:-1])) if n and len(gram) > 1 else n

    def _log(self, gram: str) -> float:
        k = self.weight
        one = (self.count(gram[2]) + 0.05) / (self.total + 0.05 * 65536)
        two = (self.count(gram[1:]) + k * one) / (self.count(gram[1]) + k)
        three = (self.count(gram) + k * two) / (self.count(gram[:2]) + k)
        return math.log(three)

    def score(self, word: str, ends: Iterable[int] | None = None) -> float:
        """Log-likelihood of the word, or of its trigrams that end at the given places."""
        w, known, out = _START + _START + word + _END, self.known, 0.0
        for i in range(2, len(w)) if ends is None else ends:
            g = w[i - 2 : i + 1]
            x = known.get(g)
            if x is None:
                if len(known) > 2_000_000:
                    known.clear()
                x = known[g] = self._log(g)
            out += x
        return out

    def best(self, word: str) -> tuple[float, tuple[str, ...], str]:
        """(gain, chain, reading) of the likeliest other reading, every one scored; gain -inf where there is none."""
        own, top = None, (-math.inf, (), word)
        ends = sorted({i + k for i, c in enumerate(word) if not c.isascii() for k in (2, 3, 4) if i + k < len(word) + 3})
        part = self.score(word, ends)
        for chain, r in chains(word).items():
            if len(r) == len(word):  # character by character: ASCII trigrams are the same
                gain = self.score(r, ends) - part
            else:
                own = self.score(word) if own is None else own
                gain = self.score(r) - own
            gain -= RARE_RIGHT * (chain[-1] not in ("utf-8", "cp1252"))
            if gain > top[0]:
                top = (gain, chain, r)
        return top


def gram_counts(words: Counter) -> Counter:
    """Hashed counts of all 1- to 3-grams of the words, with their total under -1."""
    out: Counter = Counter()
    for word, n in words.items():
        w = _START + _START + word + _END
        out[-1] += n * len(w)
        for i in range(len(w)):
            out[_slot(0, w[i])] += n
            if i:
                out[_slot(1, w[i - 1 : i + 1])] += n
            if i > 1:
                out[_slot(2, w[i - 2 : i + 1])] += n
    return out


def word_lists(docs: DataFrame) -> DataFrame:
    """``(doc_id, words, held_out)`` of the documents with a suspect word."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, ws) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (ws := suspects(t))]
            d, ws = zip(*rows, strict=True) if rows else ((), ())
            held = [zlib.crc32(repr(x).encode()) % HELD_OUT == 0 for x in d]
            yield pa.RecordBatch.from_arrays([pa.array(d, b.column(0).type), pa.array(ws, pa.list_(pa.string())), pa.array(held, pa.bool_())], ["doc_id", "words", "held_out"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, words array<string>, held_out boolean")


def character_counts(lists: DataFrame) -> dict[str, int]:
    """How often the suspect words of all documents hold each character; as many numbers as there are characters at most."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for ws in b.column(0).to_pylist():
                c.update("".join(ws))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["c", "n"])

    rows = lists.select("words").mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return {r.c: r.n for r in rows.toLocalIterator()}


def marked(lists: DataFrame, common: dict[str, int]) -> DataFrame:
    """``(words, clean, held_out)``: clean where every word looks clean."""
    shared = lists.sparkSession.sparkContext.broadcast(common)

    def run(batches) -> Iterator[pa.RecordBatch]:
        clean_word = lru_cache(200_000)(lambda w: looks_clean(w, shared.value))
        for b in batches:
            clean = [all(map(clean_word, ws)) for ws in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.bool_()), b.column(1)], ["words", "clean", "held_out"])

    return lists.select("words", "held_out").mapInArrow(run, "words array<string>, clean boolean, held_out boolean")


def word_counts(lists: DataFrame) -> DataFrame:
    """``(word, n_train, n_held)``: every distinct suspect word, and how often clean records in and out of training hold it."""
    words = marked(lists, character_counts(lists)).select(F.explode("words").alias("word"), "clean", "held_out")
    kept, held = F.col("clean") & ~F.col("held_out"), F.col("clean") & F.col("held_out")
    return words.groupBy("word").agg(F.count_if(kept).alias("n_train"), F.count_if(held).alias("n_held"))


def train(words: DataFrame) -> array:
    """Hashed n-gram counts over all of ``words(word, n_train)``; 3 * 2**20 numbers and their total."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = gram_counts(Counter(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["slot", "n"])

    rows = words.where("n_train > 0").select("word", "n_train").mapInArrow(run, "slot int, n bigint")
    return counts_array((r.slot, r.n) for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator())


def gains(words: DataFrame, counts: array) -> DataFrame:
    """Adds the ``gain`` and the ``reading`` of the likeliest other reading to ``words(word, n_train, n_held)``."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            best = [model.best(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in best], pa.float64()), pa.array([x[2] for x in best], pa.string())], [*b.schema.names, "gain", "reading"])

    return words.select("word", "n_train", "n_held").mapInArrow(run, "word string, n_train bigint, n_held bigint, gain double, reading string")


def _bin(gain: float) -> int:
    return int(max(-1.0, min(100.0, gain)) // _BIN)


def _gain_bins(scored: DataFrame, counts: array) -> dict[tuple[bool, int], int]:
    """Histogram of gains over held-out clean words, as stored and garbled on purpose."""
    shared = scored.sparkSession.sparkContext.broadcast(counts)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            bins: Counter = Counter()
            for w, n, gain in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bins[False, _bin(gain)] += n
                if kinds := sorted(garble(w).items()):
                    bins[True, _bin(model.best(kinds[zlib.crc32(w.encode("utf-8", "surrogatepass")) % len(kinds)][1])[0])] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in bins], pa.bool_()), pa.array([k[1] for k in bins], pa.int32()), pa.array(list(bins.values()), pa.int64())], ["garbled", "bin", "n"])

    held = scored.where("n_held > 0").select("word", "n_held", "gain")
    return {(r.garbled, r.bin): r.n for r in held.mapInArrow(run, "garbled boolean, bin int, n bigint").groupBy("garbled", "bin").agg(F.sum("n").alias("n")).collect()}


def choose_margin(bins: dict[tuple[bool, int], int], default: float = 6.0, least: float = 5.0) -> float:
    """The margin that finds the most garbled held-out words less FALSE_COST times the changed clean ones; the default without held-out words."""
    whole = {k: sum(n for (g, _), n in bins.items() if g is k) for k in (False, True)}
    if not whole[True]:
        return default
    share = lambda k, b: sum(n for (g, x), n in bins.items() if g is k and x >= b) / max(1, whole[k])
    return max((share(True, b) - FALSE_COST * share(False, b), -b) for b in range(int(least / _BIN), int(30 / _BIN)))[1] * -_BIN


def fit(words: DataFrame) -> tuple[DataFrame, float]:
    """(all words with gain and reading, margin) for ``words(word, n_train, n_held)``."""
    first = stash(gains(words, train(words)), "first")
    doubtful = F.col("gain") > FIRST_MARGIN
    cleaner = first.select("word", F.when(doubtful, 0).otherwise(F.col("n_train")).cast("long").alias("n_train"), F.when(doubtful, 0).otherwise(F.col("n_held")).cast("long").alias("n_held"))
    counts = train(cleaner)
    scored = stash(gains(cleaner, counts), "scored")
    return scored, choose_margin(_gain_bins(scored, counts))


def garbled_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, words)``: per document with a garbled stretch, map from each garbled word to its restored form.

    Words with the replacement character are garbled beyond recovery and map to
    null.  Null, empty and ASCII texts have none; rows with one doc_id count as
    one document; other columns are ignored.
    """
    lists = stash(word_lists(docs), "words")
    scored, margin = fit(stash(word_counts(lists), "counts"))
    lossy = F.contains("word", F.lit("\ufffd"))
    bad = scored.where(lossy | (F.col("gain") > margin)).select("word", F.when(~lossy, F.col("reading")).alias("reading"))
    held = lists.select("doc_id", F.explode(F.array_distinct("words")).alias("word"))
    return held.join(bad, "word").groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "reading"))).alias("words"))


def repair(docs: DataFrame) -> DataFrame:
    """``(doc_id, restored, n_garbled, n_lost)`` of documents with a garbled stretch; lost words stay as stored."""
    kind = dict(docs.dtypes)["doc_id"]
    bad = garbled_words(docs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fix = dict(pairs)
                restored = _STORED.sub(lambda m, fix=fix: fix.get(m.group()) or m.group(), t)
                rows.append((d, restored, len(fix), sum(v is None for v in fix.values())))
            d, t, n, m = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, b.column(0).type), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["doc_id", "restored", "n_garbled", "n_lost"])

    return docs.select("doc_id", "text").join(bad, "doc_id").mapInArrow(run, f"doc_id {kind}, restored string, n_garbled bigint, n_lost bigint")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_words(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    return repair(table(spark, sf_dir, "documents"))
