"""Filling fixed-capacity containers: dominance reduction, then best fit.

Sizes are whole tokens up to the capacity, so an instance of any number of
documents is a histogram of at most ``capacity`` counts.  The Martello-Toth
reduction and best fit run on those counts, fixing many equal containers at
once; the driver sees the histogram only.  Documents are then numbered within
their size in parallel, in hash buckets so that one size may hold a large part
of all documents, and looked up in the plan.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.runtime import stash
from twinloom.sources.tables import table

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BUCKETS = 256

Pattern = tuple[dict[int, int], int]  # size -> pieces in a container, number of such containers


def _dominant(j: int, sizes: list[int], counts: dict[int, int], capacity: int) -> list[int] | None:
    """Partners of one piece of size j that dominate every other way to fill its container; None if no rule decides.

    ``sizes`` are the sizes present, ascending; j itself has one piece fewer.
    A set dominates another if each part of some partition of the other fits
    into one of its pieces.
    """
    room = capacity - j
    n = lambda s: counts.get(s, 0) - (s == j)
    at = bisect.bisect_right(sizes, room)
    while at and n(sizes[at - 1]) <= 0:
        at -= 1
    if not at:
        return []  # nothing fits beside it
    best = sizes[at - 1]
    if best == room:
        return [best]  # full
    low: list[int] = []
    for s in sizes:
        low += [s] * min(3 - len(low), max(0, n(s)))
        if len(low) == 3:
            break
    if len(low) < 2 or low[0] + low[1] > room:
        return [best]  # one more piece at most: the largest dominates
    if len(low) == 3 and sum(low) <= room:
        return None
    # two more pieces at most: the greatest sum of a pair, and the greatest smaller piece of any pair
    top, second = 0, 0
    i, k = 0, at - 1
    while i <= k:
        a, b = sizes[i], sizes[k]
        if n(a) <= 0 or (i == k and n(a) < 2):
            i += 1
        elif n(b) <= 0:
            k -= 1
        elif a + b <= room:
            top, second = max(top, a + b), max(second, a)
            i += 1
        else:
            k -= 1
    for s in sizes[:at]:
        if 2 * s <= room and n(s) >= 2:
            top, second = max(top, 2 * s), max(second, s)
    if best >= top:
        return [best]
    rest = bisect.bisect_right(sizes, room - best)
    while rest and n(sizes[rest - 1]) - (sizes[rest - 1] == best) <= 0:
        rest -= 1
    if rest and sizes[rest - 1] >= second:
        return [best, sizes[rest - 1]]
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Containers fixed by dominance, and the counts that remain."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    for j in sorted(left, reverse=True):
        while left.get(j, 0) > 0:
            sizes = sorted(left)
            partners = _dominant(j, sizes, left, capacity)
            if partners is None:
                break
            need: dict[int, int] = {}
            for s in (j, *partners):
                need[s] = need.get(s, 0) + 1
            # as sizes only run out, what dominates once dominates until one of them is used up
            times = min(left[s] // m for s, m in need.items())
            fixed.append((need, times))
            for s, m in need.items():
                left[s] -= m * times
                if not left[s]:
                    del left[s]
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing over counts."""
    open_: dict[int, list[Pattern]] = {}
    room: list[int] = []
    done: list[Pattern] = []

    def keep(pattern: dict[int, int], times: int, free: int) -> None:
        if not times:
            return
        if not free:
            done.append((pattern, times))
            return
        if free not in open_:
            open_[free] = []
            bisect.insort(room, free)
        open_[free].append((pattern, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(room, s)
            if at == len(room):
                pattern, times, free = {}, n, capacity
            else:
                free = room[at]
                pattern, times = open_[free].pop()
                if not open_[free]:
                    del open_[free]
                    room.pop(at)
            m = free // s
            whole = min(times, n // m)
            keep(pattern | {s: m}, whole, free - m * s)
            n -= whole * m
            times = times - whole if pattern else min(1, n)
            if n and n < m and times:
                keep(pattern | {s: n}, 1, free - n * s)
                n, times = 0, times - 1
            if pattern:
                keep(pattern, times, free)
    return done + [p for f in room for p in open_[f]]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """All containers of an instance given as counts by size (1 to capacity)."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; a null text has 0 tokens.  The vocabulary is read once on the driver (about 1 MB) and shared."""
    file = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.value.splitlines())}
        count = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(count(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def fill_containers(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, container_id, n_tokens)`` for ``sized(doc_id, n_tokens)``.

    A document over the capacity is cut into full pieces and a rest; no other is
    cut.  Documents without tokens are laid in container 0, where they use no
    room.  Equal sizes are settled by hash bucket, doc_id and piece; repeated
    rows are packed as often as they come.  Empty input gives no rows.
    """
    spark = sized.sparkSession
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("long")
    pieces = sized.select("doc_id", F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.array(F.col("n_tokens") - full * capacity))).alias("piece", "n_tokens"))
    pieces = stash(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_BUCKETS))), "pieces")
    per = stash(pieces.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")), "sizes")  # at most capacity x _BUCKETS rows
    counts = {r.n_tokens: r.n for r in per.where("n_tokens > 0").groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    plan: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for pattern, times in pack(counts, capacity):
        for s, m in pattern.items():
            first, at, mult = plan.setdefault(s, ([], [], []))
            first.append(used.get(s, 0))
            at.append(container)
            mult.append(m)
            used[s] = used.get(s, 0) + m * times
        container += times
    shared = spark.sparkContext.broadcast({s: tuple(np.array(x, np.int64) for x in v) for s, v in plan.items()})

    def place(batches) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            out = np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                rows = order[lo:hi]
                if size[rows[0]]:
                    first, at, mult = table_[int(size[rows[0]])]
                    i = np.searchsorted(first, rank[rows], "right") - 1
                    out[rows] = at[i] + (rank[rows] - first[i]) // mult[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), b.column(2)], ["doc_id", "piece", "container_id", "n_tokens"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("n_tokens", "bucket", before.alias("before"))
    row = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("row", row).join(offsets, ["n_tokens", "bucket"]).select("doc_id", "piece", "n_tokens", (F.col("before") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, container_id bigint, n_tokens bigint")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each document or piece."""
    return fill_containers(token_counts(table(spark, sf_dir, "documents")))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the least possible number of containers, and unused room."""
    per = p6_packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / CAPACITY)).withColumn("unused", F.col("containers") * CAPACITY - F.col("tokens"))
