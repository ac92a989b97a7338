"""Duplicates hidden by formatting differences: sort, then scan adjacent runs.

Canonical records (the plain forms of both texts) are range-partitioned and
externally sorted by a 128-bit key of both forms, then by the full forms and
the record id; Spark's sort spills to disk as needed.  A scan of each sorted
partition compares the full forms of neighbours and numbers the runs.  As the
record id is part of the sort key, a run that holds a large part of all rows is
spread over many partitions; only runs of a partition's first and last key can be
cut by its ends, and they are put together again by their full forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm.plain import key, parse_line, plain
from twinloom.runtime import shuffle_width, stash
from twinloom.sources.tables import table

_CANON = "digest binary, record_id bigint, human binary, llm binary"


def canonical(records: DataFrame) -> DataFrame:
    """``(digest, record_id, human, llm)``; records with an empty plain form are left out.  Columns: record_id, human_src, llm_src, or record_id, line."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            if b.num_columns == 2:
                rows = ((i, *(parse_line(x) or (None, None))) for i, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
            else:
                rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            for i, h, m in rows:
                h, m = plain(h), plain(m)
                if i is not None and h and m:
                    out.append((key(key(h) + key(m)), i, h, m))
            d, i, h, m = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(i, pa.int64()), pa.array(h, pa.binary()), pa.array(m, pa.binary())], ["digest", "record_id", "human", "llm"])

    return records.mapInArrow(run, _CANON)


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """``(part, run, first_id, record_id, human, llm)`` of a sorted partition; the run's full forms are compared.

    The forms are null but in one more row, without record_id, for each run of the first and last digest.
    """
    part, run, last, first = TaskContext.get().partitionId(), -1, None, None
    head: list[tuple] | None = None  # runs of the first digest, and of the one that is being read
    tail: list[tuple] = []

    def rows(*columns) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "run", "first_id", "record_id", "human", "llm"])

    for b in batches:
        runs, firsts = [], []
        for d, i, h, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (d, h, m) != last:
                if last is not None and d != last[0]:
                    head, tail = tail if head is None else head, []
                run, last, first = run + 1, (d, h, m), i
                tail.append((part, run, i, None, h, m))
            runs.append(run)
            firsts.append(first)
        none = [None] * len(runs)
        yield rows([part] * len(runs), runs, firsts, b.column(1), none, none)
    if last is not None:
        yield rows(*zip(*(head or []), *tail, strict=True))


def copies(canon: DataFrame) -> DataFrame:
    """``(keep_id, record_id, n_copies)`` per record: the smallest record_id of its set of copies, and the set's size.

    Ties between equal records are settled by record_id; a record_id delivered
    twice with equal content counts once.
    """
    spark = canon.sparkSession
    ordered = canon.repartitionByRange(shuffle_width(spark), "digest", "record_id").sortWithinPartitions("digest", "human", "llm", "record_id")
    scanned = stash(ordered.mapInArrow(_scan, "part int, run bigint, first_id bigint, record_id bigint, human binary, llm binary").dropDuplicates(["part", "run", "record_id"]), "runs")
    runs, edges = scanned.where("record_id is not null").select("part", "run", "first_id", "record_id"), scanned.where("record_id is null").select("part", "run", "human", "llm")
    per_part = runs.groupBy("part", "run").agg(F.min("first_id").alias("first_id"), F.count("*").alias("n"))
    # equal full forms have equal digests, so they meet at partition ends only; two texts of one 128-bit digest stay apart
    per_part = per_part.hint("merge")  # the files look small without their forms, but aren't bounded: no broadcast
    cut = per_part.join(edges, ["part", "run"]).groupBy("human", "llm").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("n_copies"), F.collect_list(F.struct("part", "run")).alias("at"))
    cut = cut.select(F.explode("at").alias("at"), "keep_id", "n_copies").select("at.part", "at.run", "keep_id", "n_copies")
    inner = per_part.join(edges.select("part", "run"), ["part", "run"], "left_anti").select("part", "run", F.col("first_id").alias("keep_id"), F.col("n").alias("n_copies"))
    return runs.hint("merge").join(inner.unionByName(cut), ["part", "run"]).select("keep_id", "record_id", "n_copies")


def _task_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "task1").select("record_id", "human_src", "llm_src"), table(spark, sf_dir, "task1_raw").select("record_id", "line")


def task_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies over task1 and the valid lines of task1_raw; other lines are no records."""
    parsed, raw = _task_records(spark, sf_dir)
    return copies(canonical(parsed).unionByName(canonical(raw)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_copies(spark, sf_dir).where("record_id <> keep_id").select("keep_id", "record_id")


def p5_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per set of copies with its number of copies."""
    return task_copies(spark, sf_dir).where("record_id = keep_id").select("keep_id", "n_copies")
