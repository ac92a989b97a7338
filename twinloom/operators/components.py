"""Exact-content components and their balanced assignment to folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.operators.ranking import hash_positions
from twinloom.runtime import discard, stash


def content_components(members: DataFrame) -> DataFrame:
    """``(node, root)``: nodes of ``members(node, key)`` connected by equal keys; the root is the least node.

    In each round every root hooks to the least root that shares a key with it,
    hooks are shortened by pointer jumping, and keys whose roots have become one
    are dropped, so that the rounds shrink.  The rounds' hooks are then expanded,
    last to first.  Null keys connect nothing.
    """
    links = stash(members.where("key is not null").select("key", F.col("node").alias("root")).distinct(), "links")
    hooks: list[DataFrame] = []
    while True:
        least = links.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "least")
        live = stash(links.join(least, "key"), "live")
        discard(links)
        if not live.limit(1).count():
            break
        hook = live.groupBy("root").agg(F.min("least").alias("next"))
        for _ in range(2):
            onward = hook.select(F.col("root").alias("next"), F.col("next").alias("jump"))
            hook = hook.join(onward, "next", "left").select("root", F.coalesce("jump", "next").alias("next"))
        hook = stash(hook, "hooks")
        links = stash(live.join(hook, "root").select("key", F.col("next").alias("root")).distinct(), "links")
        discard(live)
        hooks.append(hook)
    nodes = members.select("node").distinct()
    final = nodes.select("node", F.col("node").alias("root")) if not hooks else hooks[-1].select(F.col("root").alias("node"), F.col("next").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = final.select(F.col("node").alias("next"), F.col("root").alias("last"))
        final = hook.join(later, "next", "left").select(F.col("root").alias("node"), F.coalesce("last", "next").alias("root"))
    return nodes.join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root")) if hooks else final


def fold_plan(sizes: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy least-loaded folds for components given as (size, count), as ``(size, first, last + 1, cycle)``.

    The component of rank r within its size goes to ``cycle[(r - first) % len(cycle)]``.
    Among equal sizes the greedy order merges the folds' loads spaced by the size:
    it is a fixed cycle of the folds reached so far until the next fold is.
    """
    loads = [0] * n_folds
    plan = []
    for size, count in sorted(sizes, reverse=True):
        done, active = 0, []
        entering = sorted(range(n_folds), key=lambda f: (loads[f], f))
        given = [0] * n_folds
        while done < count:
            if entering:
                active.append(entering.pop(0))
            cycle = sorted(active, key=lambda f: (loads[f] + given[f] * size, f))
            room = count - done
            if entering:  # places before the next fold's first turn
                at = (loads[entering[0]], entering[0])
                room = min(room, sum(max(0, -(-(at[0] - loads[f] - given[f] * size + (f < at[1])) // size)) for f in active))
            if room:
                plan.append((size, done, done + room, cycle))
                for i, f in enumerate(cycle):
                    given[f] += (room - i + len(cycle) - 1) // len(cycle) if room > i else 0
                done += room
        for f in range(n_folds):
            loads[f] += given[f] * size
    return plan


def assign_folds(components: DataFrame, n_folds: int) -> DataFrame:
    """Adds ``fold`` to ``components(language, root, size, tie)``: larger first, then by tie hash, to the least loaded fold, the lowest on ties."""
    spark = components.sparkSession
    ranked = hash_positions(components, ["language", "size"], "tie", "root", "rank").drop("n")
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in components.groupBy("language", "size").agg(F.count("*").alias("n")).collect():  # n nodes have at most sqrt(2 n) sizes
        sizes.setdefault(r.language, []).append((r["size"], r.n))
    rows = [(lang, *p) for lang, s in sizes.items() for p in fold_plan(s, n_folds)]
    plan = spark.createDataFrame(rows, "language string, size bigint, first bigint, last bigint, cycle array<int>")
    placed = ranked.join(plan, ["language", "size"]).where("rank >= first and rank < last")
    return placed.withColumn("fold", F.element_at("cycle", ((F.col("rank") - F.col("first")) % F.size("cycle") + 1).cast("int"))).drop("rank", "first", "last", "cycle")
