"""Positive and cross-component negative pairs within (language, seed, fold, side, generator)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.operators.ranking import hash_positions
from twinloom.runtime import stash

GROUP = ["language", "seed", "fold", "side", "generator"]
FIRST_WINDOW = 64
_BLOCK = 1024


def order_digest(*parts: Column) -> Column:
    """SHA-256 that orders rows; parts are joined by ``|``."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def sides(bank: DataFrame, folds: DataFrame, seeds: list[int], n_folds: int) -> DataFrame:
    """Every bank row on its side of every fold: test in its component's fold, train in all others."""
    spark = bank.sparkSession
    axes = spark.createDataFrame([(s, f) for s in seeds for f in range(n_folds)], "seed int, fold int")
    own = bank.join(folds.select("language", "origin", "seed", F.col("fold").alias("own"), "root"), ["language", "origin"])
    return own.join(F.broadcast(axes), "seed").withColumn("side", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")).drop("own")


def positions(members: DataFrame) -> DataFrame:
    """Hash-ordered positions of the origins in each group."""
    digest = order_digest(*(F.col(c).cast("string") for c in GROUP), F.col("origin"))
    return hash_positions(members.withColumn("_digest", digest), GROUP, "_digest", "origin").drop("_digest")


def derangement_offsets(placed: DataFrame) -> DataFrame:
    """Smallest cyclic offset at which no position meets one of its own component, by group; null where there is none.

    An offset is bad if two positions of a component lie that far apart.  Bad
    offsets are sought in windows that widen eightfold a round, so that the rounds
    grow with the logarithm of a group's size: positions are cut into buckets of
    that width and a component's positions are compared with those of the bucket
    a window away and the next.
    """
    groups = stash(placed.groupBy(*GROUP).agg(F.max("n").alias("n")), "groups")
    base = stash(placed.select(*GROUP, "root", "pos", "n"), "positions")
    found: list[DataFrame] = []
    left, low, width = groups.where("n > 1"), 1, FIRST_WINDOW
    while left.limit(1).count():
        # distance d from pos to pos + d (mod n): unroll the ring once
        here = base.join(left.select(*GROUP), GROUP, "left_semi")
        ring = here.select(*GROUP, "root", F.explode(F.array(F.col("pos"), F.col("pos") + F.col("n"))).alias("to")).withColumn("bucket", F.floor(F.col("to") / width))
        first = F.floor((F.col("pos") + low) / width)
        start = here.select(*GROUP, "root", "pos", "n", F.explode(F.array(first, first + 1)).alias("bucket"))
        apart = start.join(ring, [*GROUP, "root", "bucket"]).withColumn("d", F.col("to") - F.col("pos"))
        bad = apart.where((F.col("d") >= low) & (F.col("d") < low + width) & (F.col("d") < F.col("n"))).select(*GROUP, "d").distinct()
        tried = left.select(*GROUP, F.explode(F.sequence(F.lit(low).cast("bigint"), F.least(F.lit(low + width), F.col("n")) - 1)).alias("d"))
        good = stash(tried.join(bad, [*GROUP, "d"], "left_anti").groupBy(*GROUP).agg(F.min("d").alias("offset")), "offsets")
        found.append(good)
        low += width
        width *= 8
        left = stash(left.join(good, GROUP, "left_anti").where(F.col("n") > low), "left")
    out = groups.select(*GROUP, F.lit(None).cast("bigint").alias("offset")).limit(0)
    for f in found:
        out = out.unionByName(f)
    return groups.select(*GROUP).join(out, GROUP, "left")


def current_negatives(placed: DataFrame) -> DataFrame:
    """``(GROUP, human_origin, candidate_origin)``: the cyclic derangement by each group's offset; groups without one have none, see derangement_offsets."""
    offsets = derangement_offsets(placed).where("offset is not null")
    human = placed.join(offsets, GROUP).select(*GROUP, F.col("origin").alias("human_origin"), F.pmod(F.col("pos") + F.col("offset"), F.col("n")).alias("pos"))
    candidate = placed.select(*GROUP, "pos", F.col("origin").alias("candidate_origin"))
    return human.join(candidate, [*GROUP, "pos"]).drop("pos")


def complete_negatives(placed: DataFrame) -> DataFrame:
    """current_negatives, or an error that names groups in which no cyclic derangement keeps components apart."""
    lacking = derangement_offsets(placed).where("offset is null").limit(3).collect()  # for the message
    if lacking:
        raise ValueError("no complete derangement: " + "; ".join(str(tuple(r)[:-1]) for r in lacking))
    return current_negatives(placed)


def next_of_other(placed: DataFrame, stretch: int) -> DataFrame:
    """``(GROUP, pos, here, other, next)``: of each place of the hash order its origin, its root and the first origin after it, around
    the ring, that is of another component; null where the component fills the group.

    Places are scanned in stretches; where a component goes on to the end of one,
    the first change of root from the next stretch on counts, from a table of one
    row a stretch.
    """
    back = Window.partitionBy(*GROUP, "stretch").orderBy(F.desc("pos"))
    ring = placed.select(*GROUP, "pos", "origin", "root", F.floor(F.col("pos") / stretch).alias("stretch"))
    change = F.when(F.col("root") != F.lead("root").over(back), F.col("origin")).alias("change")  # lead: the place before
    ring = ring.select("*", change)
    earliest = lambda value, place: F.min_by(value, F.when(F.col(value).isNotNull(), F.col(place)))
    ends = ring.groupBy(*GROUP, "stretch").agg(F.min_by("root", "pos").alias("first"), F.max_by("root", "pos").alias("last"), F.min_by("origin", "pos").alias("origin"), earliest("change", "pos").alias("change"))
    ends = stash(ends, "stretches")
    group = Window.partitionBy(*GROUP)
    before = F.coalesce(F.lag("last").over(group.orderBy("stretch")), F.max_by("last", "stretch").over(group))
    ends = ends.select(*GROUP, "stretch", F.when(F.col("first") != before, F.col("origin")).otherwise(F.col("change")).alias("entry"))
    later = F.last("entry", ignorenulls=True).over(group.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*GROUP, "stretch", F.coalesce(later, earliest("entry", "stretch").over(group)).alias("beyond"))
    inside = F.last("change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    scanned = ring.select(*GROUP, "stretch", "pos", F.col("origin").alias("here"), F.col("root").alias("other"), inside.alias("inside"))
    return scanned.join(ends, [*GROUP, "stretch"]).select(*GROUP, "pos", "here", "other", F.coalesce("inside", "beyond").alias("next"))


def random_negatives(placed: DataFrame, stretch: int = 4096) -> DataFrame:
    """``(GROUP, human_origin, candidate_origin)``: a digest of the human origin picks a place in the hash order, the next
    origin of another component from there on is taken.

    The pick is uniform over the order and needs one lookup: if the place is of the
    human's own component, the place's next origin of another component is the
    human's too.  Humans whose component fills the group don't come out.  The number of jobs
    depends neither on the groups nor on the components.
    """
    digest = order_digest(F.lit("random"), *(F.col(c).cast("string") for c in GROUP), F.col("origin"))
    start = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), F.col("n"))
    human = placed.select(*GROUP, F.col("origin").alias("human_origin"), "root", start.alias("pos"))
    met = human.join(next_of_other(placed, stretch), [*GROUP, "pos"])
    candidate = F.when(F.col("root") != F.col("other"), F.col("here")).otherwise(F.col("next")).alias("candidate_origin")
    return met.select(*GROUP, "human_origin", candidate).where("candidate_origin is not null")


def _packed(df: DataFrame, by: list[str], cols: list[str], n_blocks: int) -> DataFrame:
    """Blocks of at most about _BLOCK rows: arrays of each column by hash bucket within ``by``."""
    block = F.pmod(F.xxhash64(cols[0]), F.lit(n_blocks)).alias("block")
    lists = df.select(*by, F.struct(*cols).alias("row"), block).groupBy(*by, "block").agg(F.collect_list("row").alias("rows"))
    return lists.select(*by, "block", *(F.col(f"rows.{c}").alias(c) for c in cols))


def nearest_other(queries: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, query, id, distance)``: for each of ``queries(by, query, root, vector)`` the nearest of ``rows(by, id, root, vector)``
    of another root, by Euclidean distance, the smallest id on ties.

    Exact.  Both sides are packed into blocks by hash, of about 1,024 rows each
    whatever their number, and every block of queries meets every block of rows
    of its group as two matrices; one candidate a query and block comes out.
    Rows with a null vector or root take no part.
    """
    n = lambda df: max(1, -(-df.count() // _BLOCK))
    queries, rows = (d.where("vector is not null and root is not null") for d in (queries, rows))
    q = _packed(queries, by, ["query", "root", "vector"], n(queries)).withColumnsRenamed({"root": "q_root", "vector": "q_vector", "block": "q_block"})
    r = _packed(rows, by, ["id", "root", "vector"], n(rows)).withColumnRenamed("block", "r_block")
    types = dict(queries.dtypes) | dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"query {types['query']}", f"id {types['id']}", "distance double"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x, y = np.array(row["q_vector"], float), np.array(row["vector"], float)
                ids, q_root, r_root = row["id"], np.array(row["q_root"]), np.array(row["root"])
                rank = np.argsort(np.array(ids), kind="stable")  # the first minimum is then the smallest id
                y, r_root, ids = y[rank], r_root[rank], [ids[i] for i in rank]
                out = []
                for at in range(len(x)):
                    d = np.sqrt(((y - x[at]) ** 2).sum(axis=1))
                    d[r_root == q_root[at]] = np.inf
                    if np.isfinite(d[k := int(d.argmin())]):
                        out.append((*(row[c] for c in by), row["query"][at], ids[k], float(d[k])))
                cols = list(zip(*out, strict=True)) if out else [()] * (len(by) + 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(n).type if n in by else b.schema.field(n).type.value_type if n in ("query", "id") else pa.float64()) for n, c in zip([*by, "query", "id", "distance"], cols, strict=True)], [*by, "query", "id", "distance"])

    near = q.join(r, by).select(*by, "query", "q_root", "q_vector", "id", "root", "vector").repartition(*by, "query").mapInArrow(run, schema)
    best = near.groupBy(*by, "query").agg(F.min(F.struct("distance", "id")).alias("m"))
    return best.select(*by, "query", "m.id", "m.distance")


def labelled_pairs(placed: DataFrame, negatives: DataFrame, mode: str) -> DataFrame:
    """Both labels: each human with itself (1) and with its negative (0), with digests and components of both ends."""
    end = lambda role: placed.select(*GROUP, F.col("origin").alias(f"{role}_origin"), F.col(f"{role}_sha").alias(f"{role}_sha"), F.col("root").alias(f"{role}_root"))
    same = placed.select(*GROUP, F.col("origin").alias("human_origin"), F.col("origin").alias("candidate_origin"), F.lit(1).alias("label"), F.lit(None).cast("string").alias("mode"))
    other = negatives.select(*GROUP, "human_origin", "candidate_origin", F.lit(0).alias("label"), F.lit(mode).alias("mode"))
    return same.unionByName(other).join(end("human"), [*GROUP, "human_origin"]).join(end("candidate"), [*GROUP, "candidate_origin"])
