"""Consolidating pairwise matches into groups by randomised graph contraction.

Every round draws a fresh hash order of the vertices; each vertex hooks to the
smallest member of its closed neighbourhood, edges are relabelled by those
representatives and deduplicated, and the rounds repeat until no edge is left.
The expected number of vertices with edges falls by a constant factor a round.
The rounds' mappings are then expanded, last to first, to the final label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.runtime import discard, norm_digest, norm_origin, stash
from twinloom.sources.tables import table

#: Sub-groups into which the members of one shared key are spread before linking.
SALTS = 1024


def _order(seed: int, c: Column) -> Column:
    return F.xxhash64(F.lit(seed), c)


def contract(edges: DataFrame, seed: int = 17) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per vertex with an edge.

    Null ends, loops and repeated or reversed pairs are allowed and add nothing;
    vertices that only have loops don't come out.  An empty table gives none.
    Each round only joins and aggregates with map-side combine; nothing is
    collected but the count of remaining edges.
    """
    live = stash(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    hooks: list[DataFrame] = []
    while live.limit(1).count():
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
        s = seed + len(hooks)
        best = both.groupBy(F.col("e.v").alias("v")).agg(F.min(F.struct(_order(s, F.col("e.w")).alias("h"), F.col("e.w").alias("w"))).alias("m"))
        own = F.struct(_order(s, F.col("v")).alias("h"), F.col("v").alias("w"))
        hook = stash(best.select("v", F.least("m", own)["w"].alias("r")), "hooks")
        left, right = hook.select(F.col("v").alias("a"), F.col("r").alias("ra")), hook.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        shrunk = live.join(left, "a").join(right, "b").where("ra <> rb")
        after = stash(shrunk.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(live)
        live = after
        hooks.append(hook)
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    final = hooks[-1].select(F.col("v").alias("node"), F.col("r").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = final.withColumnRenamed("node", "r")
        final = hook.join(later, "r", "left").select(F.col("v").alias("node"), F.coalesce("root", "r").alias("root"))
    return final


def consolidate(pairs: DataFrame, seed: int = 17) -> DataFrame:
    """One row ``(node, group_id)`` per linked record; ``group_id`` is its group's smallest member."""
    roots = stash(contract(pairs, seed), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("group_id"))
    return roots.join(least, "root").select("node", "group_id")


def shared_key_edges(members: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes of ``members(key, node)`` with an equal key.

    A key of k nodes gives fewer than k edges: each node to the least of its
    salted sub-group, each sub-group's least to the key's.  No task sees more
    than a sub-group, so one key may hold a large part of all rows.
    """
    known = stash(members.where(F.col("key").isNotNull() & F.col("node").isNotNull()).distinct(), "members")
    salted = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    near = salted.select("node", F.min("node").over(Window.partitionBy("key", "salt")).alias("least"))
    heads = salted.groupBy("key", "salt").agg(F.min("node").alias("node"))
    far = heads.select("node", F.min("node").over(Window.partitionBy("key")).alias("least"))
    return near.unionByName(far).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def origin_groups(bank: DataFrame) -> DataFrame:
    """Origins of one language consolidated over equal digests, in either digest column.

    ``bank`` needs language, human_origin_id, human_code_sha256 and
    candidate_code_sha256; other columns are ignored.  Rows without language or
    origin take no part, null digests match nothing, repeated rows change
    nothing, and origins without a partner don't come out.
    """
    rows = bank.select(
        "language",
        norm_origin(F.col("human_origin_id")).alias("origin"),
        F.explode(F.array(norm_digest(F.col("human_code_sha256")), norm_digest(F.col("candidate_code_sha256")))).alias("digest"),
    ).where("language is not null and origin is not null and digest is not null")
    members = rows.select(F.concat_ws("\x01", "language", "digest").alias("key"), F.concat_ws("\x01", "language", "origin").alias("node"))
    part = lambda c, i: F.element_at(F.split(c, "\x01"), i)
    return consolidate(shared_key_edges(members)).select(part("node", 1).alias("language"), part("group_id", 2).alias("group_id"), part("node", 2).alias("human_origin_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin_groups(table(spark, sf_dir, "feature_bank"))


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by language and size."""
    sizes = origin_groups(table(spark, sf_dir, "feature_bank")).groupBy("language", "group_id").agg(F.count("*").alias("origins"))
    return sizes.groupBy("language", "origins").agg(F.count("*").alias("n_groups"))
