"""Same or near-same records across splits by a partitioned suffix array.

Every record is a text of symbols, one for each token (the token's 128-bit
digest); all texts together, cut at record ends, are the concatenated text.  Its
suffixes are range-partitioned and sorted, copies of one suffix spread by a hash.
Among all suffixes of the reference split, the one with the longest common prefix
with a given suffix is its nearest one above or below in that order, so a scan
of each sorted partition computes, for every suffix of another split, the common
prefix with both; where the nearest one lies in another partition, the partitions'
first and last reference suffixes settle it.  Common prefixes of at least
``min_tokens`` symbols are shared spans, merged into a coverage per record.

A suffix is written up to ``LONGEST`` symbols (at least ``min_tokens``).  That
bounds a row and loses nothing: a longer span goes on in the suffixes that begin
inside it, and the coverage is their union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.runtime import norm_digest, norm_origin, shuffle_width, stash
from twinloom.sources.tables import table

LONGEST = 32
SUFFIXES_A_TASK = 1_000_000
_SYMBOL = 16
_NONE = bytes(_SYMBOL)  # a null token's symbol, equal to none


def suffixes(records: DataFrame, min_tokens: int) -> DataFrame:
    """``(id, pos, seen, suffix, tie)`` for every position of ``records(id, seen, tokens)`` where a span fits; reference suffixes carry no id."""
    length = max(LONGEST, min_tokens)
    symbols = F.transform("tokens", lambda t: F.coalesce(F.unhex(F.md5(t)), F.lit(_NONE)))
    texts = records.where("seen is not null").select("id", "seen", symbols.alias("symbols")).where(F.size("symbols") >= min_tokens)
    starts = F.sequence(F.lit(0), F.size("symbols") - min_tokens)
    cut = F.transform(starts, lambda p: F.struct(p.alias("pos"), F.aggregate(F.slice("symbols", p + 1, length), F.lit(b""), lambda a, x: F.concat(a, x)).alias("suffix")))
    rows = texts.select("id", "seen", F.explode(cut).alias("s")).where(F.substring("s.suffix", 1, _SYMBOL) != F.lit(_NONE))
    return rows.select(F.when(~F.col("seen"), F.col("id")).alias("id"), "s.pos", "seen", "s.suffix", F.xxhash64("id", "s.pos").alias("tie"))


def _padded(column: pa.Array) -> np.ndarray:
    """Suffixes as rows of symbols, each two numbers, filled up with the null symbol."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // _SYMBOL
    symbols = np.frombuffer(column.buffers()[2], np.uint64)[: at[-1] * 2].reshape(-1, 2)[at[0] :]
    n = np.diff(at)
    out = np.zeros((len(n), int(n.max()), 2), np.uint64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(symbols)) - np.repeat(at[:-1] - at[0], n)] = symbols
    return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of symbols; null symbols equal nothing."""
    same = (a == b).all(axis=2) & a.any(axis=2)
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _scanner(min_tokens: int):
    """Scan of one sorted partition ``(id, pos, seen, suffix)``.

    Gives each unseen suffix's longest common prefix with the partition's own
    reference suffixes; 1 (none above), 2 (none below) or 3 in ``open`` where
    another partition may hold the nearest one, with the suffix; and the first (0)
    and last (1) reference suffix as edges.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), list(batches)
        if not sum(b.num_rows for b in held):
            return
        got = pa.Table.from_batches(held).combine_chunks()
        ids, pos, suffix = (got.column(c).chunk(0) for c in ("id", "pos", "suffix"))
        suffix = suffix.cast(pa.binary())
        seen = got.column("seen").to_numpy().astype(bool)
        text = _padded(suffix)
        place = np.arange(len(seen))
        above = np.maximum.accumulate(np.where(seen, place, -1))
        below = np.minimum.accumulate(np.where(seen, place, len(seen))[::-1])[::-1]
        new = np.flatnonzero(~seen)
        best, open_ = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
        for bit, near in ((1, above[new]), (2, below[new])):
            there = (near >= 0) & (near < len(seen))
            best[there] = np.maximum(best[there], common_prefix(text[new[there]], text[near[there]]))
            open_[~there] |= bit
        keep = (best >= min_tokens) | (open_ > 0)
        new, best, open_ = new[keep], best[keep], open_[keep]
        ends = np.flatnonzero(seen)[[0, -1]] if seen.any() else np.empty(0, np.int64)
        rows = np.concatenate((new, ends))
        edge = np.arange(len(rows)) >= len(new)
        number = np.concatenate((best, np.arange(len(ends)))).astype(np.int32)
        columns = [
            pa.array(np.full(len(rows), part, np.int32)),
            ids.take(pa.array(rows)),
            pos.take(pa.array(rows)),
            pa.array(number, mask=edge),
            pa.array(np.concatenate((open_, np.zeros(len(ends), np.int32)))),
            suffix.take(pa.array(rows, mask=~edge & (np.concatenate((open_, ends)) == 0))),
            pa.array(number, mask=~edge),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["part", "id", "pos", "lcp", "open", "suffix", "edge"])

    return run


def _prefix_of(a: Column, b: Column, length: int) -> Column:
    """common_prefix of two suffixes as an expression."""
    at = lambda c, i: F.substring(c, (i * _SYMBOL + 1).cast("int"), F.lit(_SYMBOL))
    step = lambda n, i: F.when((n == i) & (at(a, i) == at(b, i)) & (F.length(at(a, i)) == _SYMBOL) & (at(a, i) != F.lit(_NONE)), i + 1).otherwise(n)
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0), step), F.lit(0))


def shared_spans(records: DataFrame, min_tokens: int) -> DataFrame:
    """``(id, pos, length)``: the longest span from each position of an unseen record (``seen`` false) that also stands in a seen one, at least ``min_tokens`` long.

    ``records`` holds id, seen (boolean: the record is in the reference split)
    and tokens (array<string>).  Null tokens match nothing; records with a null
    ``seen``, null or too short tokens take no part; repeated rows are kept; lengths
    are known up to ``LONGEST`` (or ``min_tokens``, if that is more).
    """
    spark = records.sparkSession
    parts = stash(suffixes(records, min_tokens), "suffixes")
    width = max(shuffle_width(spark), -(-parts.count() // SUFFIXES_A_TASK))
    ordered = parts.repartitionByRange(width, "suffix", "tie").sortWithinPartitions("suffix", "tie").select("id", "pos", "seen", "suffix")
    scanned = stash(ordered.mapInArrow(_scanner(min_tokens), f"part int, id {dict(parts.dtypes)['id']}, pos int, lcp int, open int, suffix binary, edge int"), "scanned")
    # two rows a partition at most
    edges = scanned.where("edge is not null").select("part", "edge", F.col("suffix").alias("e"))
    last, first = (edges.where(F.col("edge") == k).select("part", "e") for k in (1, 0))
    all_parts = spark.range(width).select(F.col("id").cast("int").alias("part"))
    above = all_parts.join(last, "part", "left").select("part", F.last("e", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    below = all_parts.join(first, "part", "left").select("part", F.first("e", True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("below"))
    around = F.broadcast(above.join(below, "part"))
    length = max(LONGEST, min_tokens)
    lcp = F.greatest(
        F.col("lcp"),
        F.when(F.col("open").bitwiseAND(1) == 1, _prefix_of(F.col("suffix"), F.col("above"), length)).otherwise(0),
        F.when(F.col("open").bitwiseAND(2) == 2, _prefix_of(F.col("suffix"), F.col("below"), length)).otherwise(0),
    )
    found = scanned.where("edge is null").join(around, "part").select("id", "pos", lcp.alias("length"))
    return found.where(F.col("length") >= min_tokens)


def coverage(records: DataFrame, min_tokens: int) -> DataFrame:
    """``(id, n_spans, covered_tokens, n_tokens)`` per unseen record with a shared span; overlapping and touching spans are one."""
    spans = shared_spans(records, min_tokens).groupBy("id", "pos").agg(F.max("length").alias("length"))
    order = Window.partitionBy("id").orderBy("pos")  # a record's positions
    reach = F.max(F.col("pos") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("reach", F.coalesce(reach, F.lit(-1))).withColumn("end", F.col("pos") + F.col("length"))
    adds = F.greatest(F.lit(0), F.col("end") - F.greatest("pos", "reach"))
    cover = merged.groupBy("id").agg(F.count_if(F.col("reach") < F.col("pos")).alias("n_spans"), F.sum(adds).alias("covered_tokens"))
    return cover.join(records.where("not seen").select("id", F.size("tokens").cast("long").alias("n_tokens")).dropDuplicates(["id"]), "id")


def _scoped(kind: str, *cols: Column) -> Column:
    return F.concat(F.lit(kind), *cols)


def pair_records(pairs: DataFrame) -> DataFrame:
    """pair_spec rows as records: digests in any language, origin ids in their language, either role."""
    digest = lambda c: _scoped("d:", norm_digest(F.col(c)))
    origin = lambda c: _scoped("o:", F.col("language"), F.lit(":"), norm_origin(F.col(c)))
    return pairs.where(F.col("side").isin("train", "valid", "test")).select(
        F.struct("side", "llm_source", "pair_id").alias("id"),
        (F.col("side") == "train").alias("seen"),
        F.array(digest("human_code_sha256"), digest("candidate_code_sha256"), origin("human_origin_id"), origin("candidate_origin_id")).alias("tokens"),
    )


def pair_coverage(pairs: DataFrame) -> DataFrame:
    """``(side, llm_source, pair_id, covered_tokens)``: each valid or test row that repeats a digest or an origin id of a train row, and how many of its four fields do.

    Rows without side count nowhere; a null language frees only the
    origin ids; a null llm_source stays null.
    """
    spans = shared_spans(pair_records(pairs), 1)
    fields = F.explode(F.sequence("pos", F.col("pos") + F.least(F.col("length"), 4 - F.col("pos")) - 1)).alias("field")
    covered = spans.select("id", fields).groupBy("id").agg(F.countDistinct("field").alias("covered_tokens"))  # four fields at most
    return covered.select("id.side", "id.llm_source", "id.pair_id", "covered_tokens")


def leaked_pairs(pairs: DataFrame) -> DataFrame:
    """``(side, llm_source, pair_id)`` of pair_coverage: a span of one field is one repeated digest or origin."""
    return pair_coverage(pairs).where("covered_tokens > 0").select("side", "llm_source", "pair_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "pair_spec"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked rows per side and source."""
    return p2_found(spark, sf_dir).groupBy("side", "llm_source").agg(F.count("*").alias("n_rows"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each leaked row is shared."""
    cover = pair_coverage(table(spark, sf_dir, "pair_spec"))
    return cover.select("side", "pair_id", "covered_tokens", F.lit(4).cast("bigint").alias("n_tokens"))
