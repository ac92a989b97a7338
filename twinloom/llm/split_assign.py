"""Splits that keep related records together: frontier components, then hash order.

Components: edges are held as hash-partitioned adjacency lists.  The first wave's
seeds are a share of the vertices drawn by hash, so that many searches run through
a large component at once; the second wave's are the vertices left whose hash is
least among their neighbours left, at least one in every component without a
seed.  The frontier of all seeds is expanded at once, ``HOPS`` hops a wave, each
joining the frontier's neighbours alone; a frontier's neighbours that are labelled
lie in it or in the one before.  What is further off becomes its own seed.  Then
every edge whose ends got two labels goes into a small graph of labels, which is
contracted, and each vertex takes the label of its component.  So the number of
rounds doesn't depend on the graph's diameter.

Split: components that hold at least one row in ``LARGE`` are at most that
many; they are placed first, largest first, where the shortfall against the
targets is greatest, over all rows and within each of the ``LARGE`` largest
sources; the other sources count as one together.  The rest follow in
the order of a hash of the component, cut where the running number of rows
fills what each split still lacks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.llm.contraction import contract
from twinloom.runtime import stash
from twinloom.sources.tables import table

#: One vertex in so many is a seed of the first wave.
SEEDS = 64
HOPS = 4
LARGE = 2_000
_BUCKETS = 4_096


def _expand(seeds: DataFrame, adjacency: DataFrame, hops: int) -> list[DataFrame]:
    """Frontiers ``(node, label)`` of all seeds, the seeds first; ``adjacency(a, b)`` holds unlabelled vertices only."""
    found = [stash(seeds.select("node", F.col("node").alias("label")), "frontier")]
    for _ in range(hops):
        reached = found[-1].join(adjacency, found[-1]["node"] == adjacency["a"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        for f in found[-2:]:
            reached = reached.join(f.select("node"), "node", "left_anti")
        found.append(stash(reached, "frontier"))
        if not found[-1].limit(1).count():
            break
    return found


def components(edges: DataFrame, seeds: int = SEEDS, hops: int = HOPS) -> DataFrame:
    """``(node, root)`` for every vertex of ``edges(a, b)``, loops included; null ends are vertices of none."""
    ends = edges.select("a", "b").where("a is not null or b is not null").select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    adjacency = stash(ends.select(both).select("e.a", "e.b").distinct().repartition("a"), "adjacency")
    nodes = adjacency.select(F.col("a").alias("node")).distinct()
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    first = union(_expand(nodes.where(F.pmod(F.xxhash64(F.lit(0), "node"), F.lit(seeds)) == 0), adjacency, hops))
    known = first.select(F.col("node").alias("a"))
    left = adjacency.join(known, "a", "left_anti").join(known.withColumnRenamed("a", "b"), "b", "left_anti")
    left = stash(left.select("a", "b"), "left")
    rank = lambda c: F.struct(F.xxhash64(F.lit(1), c), F.col(c))
    least = left.groupBy("a").agg(F.min(rank("b")).alias("m")).where(rank("a") <= F.col("m")).select(F.col("a").alias("node"))
    second = union(_expand(least, left, hops))
    near = first.unionByName(second)
    far = nodes.join(near.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    labelled = stash(near.unionByName(far), "labelled")
    end = lambda c, name: labelled.select(F.col("node").alias(c), F.col("label").alias(name))
    meets = adjacency.where("a < b").join(end("a", "x"), "a").join(end("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = stash(contract(meets), "labels").withColumnRenamed("node", "label")
    return labelled.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def _place_large(large: list, sources: list[tuple], totals: dict, shares: list[tuple[str, float]]) -> tuple[dict, dict]:
    """Split of each large component, and rows placed by (split, source); a source is a tuple of its name, () all that are pooled."""
    placed = {(s, g): 0 for s, _ in shares for g in sources}
    where = {}
    for root, counts in large:
        def cost(split: str, share: float, counts=counts) -> float:
            short = 0.0
            for g, n in counts.items():
                if share * totals[g] <= 0:
                    return -1e18
                short += n * (1 - (placed[split, g] + n / 2) / (share * totals[g]))
            return short

        best = max(shares, key=lambda x: cost(*x))[0]
        where[root] = best
        for g, n in counts.items():
            placed[best, g] += n
    return where, placed


def assign_splits(rows: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """``(id, split)`` for every row of ``rows(id, a, b, source)``.

    No component of the graph of a and b occurs in two splits.  Rows with one
    end null belong to the other end's component, rows with both null are
    components of their own.  A null source is a source.  Repeated rows go the
    same way.  Empty input gives an empty result; shares are scaled to one.
    """
    spark = rows.sparkSession
    total = sum(x for _, x in shares)
    if total <= 0:
        raise ValueError("no shares are wanted")
    shares = sorted(((s, x / total) for s, x in shares), key=lambda x: (-x[1], x[0]))
    lone = F.concat(F.lit("row:"), F.col("id").cast("string"))
    ended = rows.select("id", F.coalesce("a", "b", lone).alias("a"), F.coalesce("b", "a", lone).alias("b"), "source")
    comp = components(ended.select("a", "b"))
    rooted = stash(ended.join(comp.withColumnRenamed("node", "a"), "a").select("id", "root", "source"), "rooted")
    sizes = stash(rooted.groupBy("root", "source").agg(F.count("*").alias("n")), "sizes")
    by_source: dict = {(r.source,): r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(LARGE).collect()}
    all_rows = sizes.agg(F.sum("n")).first()[0] or 0
    named = F.coalesce(F.col("source").isin([s for s, in by_source if s is not None]), F.lit((None,) in by_source))
    if pooled := all_rows - sum(by_source.values()):
        by_source[()] = pooled
    whole = sizes.groupBy("root").agg(F.sum("n").alias("size"))
    large_roots = whole.where(F.col("size") * LARGE >= all_rows)  # at most LARGE of them
    mixed: dict[str, dict] = {}
    order: dict[str, int] = {}
    held = sizes.withColumn("named", named).groupBy("root", "named", F.when(F.col("named"), F.col("source")).alias("source")).agg(F.sum("n").alias("n"))
    for r in held.join(large_roots, "root").collect() if all_rows else []:
        mixed.setdefault(r.root, {})[(r.source,) if r.named else ()] = r.n
        order[r.root] = r.size
    large = [(k, mixed[k]) for k in sorted(mixed, key=lambda k: (-order[k], k))]
    where, placed = _place_large(large, list(by_source), by_source, shares)
    lack = {s: max(0.0, x * all_rows - sum(placed[s, g] for g in by_source)) for s, x in shares}
    scale = sum(lack.values()) or 1.0
    ends, run = [], 0.0
    for s, _ in shares:
        run += lack[s] / scale
        ends.append((s, run))
    fixed = spark.createDataFrame(list(where.items()) or [(None, None)], "root string, split string").where("root is not null")
    rest = whole.join(F.broadcast(fixed), "root", "left_anti")  # fixed: at most LARGE rows
    rest = rest.withColumn("h", F.xxhash64(F.lit("split"), "root")).withColumn("bucket", F.shiftrightunsigned("h", 52))
    per_bucket = rest.groupBy("bucket").agg(F.sum("size").alias("rows"))  # at most _BUCKETS rows
    before = per_bucket.select("bucket", F.coalesce(F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    ranked = rest.withColumn("inside", inside).join(F.broadcast(before), "bucket")
    left = max(1, all_rows - sum(order.values()))
    share = (F.col("before") + F.col("inside")) / F.lit(left)
    split = F.lit(ends[-1][0])
    for s, end in reversed(ends[:-1]):
        split = F.when(share <= end, s).otherwise(split)
    placed_all = ranked.select("root", split.alias("split")).unionByName(fixed)
    return rooted.join(placed_all, "root").select("id", "split")


def pair_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pair_spec").select(F.col("pair_id").alias("id"), F.col("human_component_id").alias("a"), F.col("candidate_component_id").alias("b"), F.col("llm_source").alias("source"))
    targets = [(r.side, r.share) for r in table(spark, sf_dir, "split_targets").where("side is not null and share is not null").orderBy("side").collect()]
    return assign_splits(pairs, targets)


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of each pair_spec row."""
    return pair_splits(spark, sf_dir).select(F.col("id").alias("pair_id"), "split")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reached share of rows by split and source."""
    out = pair_splits(spark, sf_dir).join(table(spark, sf_dir, "pair_spec").select(F.col("pair_id").alias("id"), "llm_source"), "id")
    n = out.groupBy("llm_source", "split").agg(F.count("*").alias("n_rows"))
    return n.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("llm_source")))
