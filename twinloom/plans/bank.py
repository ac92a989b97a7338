"""Positive bank, content components, folds, pairs and their audits over feature_bank."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.operators import pairing
from twinloom.operators.components import assign_folds, content_components
from twinloom.operators.pairing import GROUP
from twinloom.operators.ranking import hash_positions
from twinloom.runtime import norm_digest, norm_origin, stash
from twinloom.sources.tables import table

N_FOLDS = 5
SEED = 42
SEEDS = (42, 123, 2024)  # the closed seed axis; queries without seed column and with SQL are of SEED alone
FIRST_K = 100


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive rows with all they need, notation undone, the first delivery of each (language, origin, generator)."""
    rows = table(spark, sf_dir, "feature_bank").where("label = 1").select(
        "bank_row_id",
        "language",
        norm_origin(F.col("human_origin_id")).alias("origin"),
        F.col("llm_source").alias("generator"),
        norm_digest(F.col("human_code_sha256")).alias("human_sha"),
        norm_digest(F.col("candidate_code_sha256")).alias("candidate_sha"),
        "human",
        "llm",
    )
    rows = rows.dropna(subset=["language", "origin", "generator", "human_sha", "candidate_sha", "human", "llm"])
    return rows.groupBy("language", "origin", "generator").agg(F.min_by(F.struct("bank_row_id", "human_sha", "candidate_sha", "human", "llm"), "bank_row_id").alias("r")).select("language", "origin", "generator", "r.*")


def complete_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins that have a row of every generator."""
    rows = stash(clean_rows(spark, sf_dir), "bank")
    n = rows.select("generator").distinct().count()
    whole = rows.groupBy("language", "origin").agg(F.count("*").alias("k")).where(F.col("k") == n)
    return rows.join(whole.select("language", "origin"), ["language", "origin"], "left_semi")


def roots(bank: DataFrame) -> DataFrame:
    """``(language, origin, root)``: content components; the root is the component's least origin."""
    node = F.concat_ws("\x01", "language", "origin")
    members = bank.select(node.alias("node"), F.explode(F.array("human_sha", "candidate_sha")).alias("sha"), "language").select("node", F.concat_ws("\x01", "language", "sha").alias("key"))
    part = lambda c, i: F.element_at(F.split(c, "\x01"), i)
    return content_components(members).select(part("node", 1).alias("language"), part("node", 2).alias("origin"), part("root", 2).alias("root"))


def component_table(rooted: DataFrame, seed: int) -> DataFrame:
    """``(language, root, size, tie)``: components with their size and tie hash under a seed."""
    sizes = rooted.groupBy("language", "root").agg(F.count("*").alias("size"))
    return sizes.withColumn("tie", F.sha2(F.concat_ws("|", F.lit(str(seed)), "language", "root"), 256))


def folds(bank: DataFrame, seeds: tuple[int, ...] = (SEED,), n_folds: int = N_FOLDS) -> DataFrame:
    """``(language, origin, root, seed, fold)``."""
    rooted = stash(roots(bank), "roots")
    placed = [assign_folds(component_table(rooted, s), n_folds).select("language", "root", "fold", F.lit(s).alias("seed")) for s in seeds]
    return rooted.join(reduce(DataFrame.unionByName, placed), ["language", "root"])


def placed_sides(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """Bank rows by fold side with their hash positions."""
    bank = complete_bank(spark, sf_dir)
    members = pairing.sides(bank.select("language", "origin", "generator", "human_sha", "candidate_sha"), folds(bank, seeds), list(seeds), N_FOLDS)
    return stash(pairing.positions(members), "placed")


def current_pairs(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    placed = placed_sides(spark, sf_dir, seeds)
    return pairing.labelled_pairs(placed, pairing.current_negatives(placed), "current")


def bank_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first FIRST_K origins of each language, in order (the limit is the feature)."""
    rows = clean_rows(spark, sf_dir).select("bank_row_id", "language", "origin", "generator")
    origins = rows.select("language", "origin").distinct()
    # top-k by language: Spark ranks with a limit before the shuffle
    ranked = origins.selectExpr("*", "row_number() over (partition by language order by origin) as place").where(F.col("place") <= FIRST_K)
    return rows.join(F.broadcast(ranked), ["language", "origin"]).select("bank_row_id", "language", "origin", "generator", F.col("place").cast("bigint").alias("place"))


def complete_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole origin groups in order of first appearance until at least 200 rows and three groups (the limit is the feature)."""
    rows = clean_rows(spark, sf_dir)
    groups = rows.groupBy("language", "origin").agg(F.min("bank_row_id").alias("first_row"), F.count("*").alias("n_rows"))
    head = groups.orderBy("first_row").limit(200)  # every group has a row, so 200 groups reach 200 rows
    taken = head.selectExpr("*", "sum(n_rows) over (order by first_row) as running", "row_number() over (order by first_row) as place")
    return taken.where("running - n_rows < 200 or place <= 3").select("language", "origin", "first_row", "n_rows")


def bank_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing (origin, generator) rows: all combinations less those there, and rows delivered more than once."""
    rows = table(spark, sf_dir, "feature_bank").where("label = 1 and language is not null and llm_source is not null").select("language", norm_origin(F.col("human_origin_id")).alias("origin"), F.col("llm_source").alias("generator")).where("origin is not null")
    there = rows.groupBy("language", "origin", "generator").agg(F.count("*").alias("n_rows"))
    generators = rows.select("generator").distinct()  # a closed axis of four names
    wanted = rows.select("language", "origin").distinct().join(F.broadcast(generators))
    state = wanted.join(there, ["language", "origin", "generator"], "left").fillna(0, ["n_rows"])
    return state.groupBy("language", "generator").agg(F.count_if(F.expr("n_rows = 0")).alias("missing"), F.count_if(F.expr("n_rows > 1")).alias("repeated"), F.count("*").alias("expected"))


def content_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(language, sha, origin, least)``: each origin that shares a digest with another, linked to the least origin of the digest."""
    bank = complete_bank(spark, sf_dir)
    members = bank.select("language", "origin", F.explode(F.array("human_sha", "candidate_sha")).alias("sha")).distinct()
    least = members.groupBy("language", "sha").agg(F.min("origin").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    return members.join(least, ["language", "sha"]).where("origin <> least")


def bank_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(complete_bank(spark, sf_dir))


def component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by (-size, tie hash): their place within each language and size."""
    comps = component_table(bank_components(spark, sf_dir), SEED)
    return hash_positions(comps, ["language", "size"], "tie", "root", "place").select("language", "root", "size", "place")


def _seed(seeds: tuple[int, ...]) -> list[str]:
    return ["seed"] if len(seeds) > 1 else []


def fold_assignment(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    return folds(complete_bank(spark, sf_dir), seeds).select("language", *_seed(seeds), "origin", "root", F.col("fold").cast("bigint").alias("fold"))


def hash_order_positions(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    return placed_sides(spark, sf_dir, seeds).select("language", *_seed(seeds), F.col("fold").cast("bigint").alias("fold"), "side", "generator", "origin", "pos", "n")


def derangement_offset(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    return pairing.derangement_offsets(placed_sides(spark, sf_dir, seeds)).select("language", *_seed(seeds), F.col("fold").cast("bigint").alias("fold"), "side", "generator", "offset", F.when(F.col("offset").isNull(), "no derangement").otherwise("ok").alias("status"))


def negatives_current(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    return pairing.current_negatives(placed_sides(spark, sf_dir, seeds)).select("language", *_seed(seeds), F.col("fold").cast("bigint").alias("fold"), "side", "generator", "human_origin", "candidate_origin")


def negatives_random(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    return pairing.random_negatives(placed_sides(spark, sf_dir, seeds)).select("language", *_seed(seeds), F.col("fold").cast("bigint").alias("fold"), "side", "generator", "human_origin", "candidate_origin")


def negatives_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest candidate of another component, by the 28 unscaled measurements; queries are the rows whose id is divisible by 20, against all rows."""
    bank = complete_bank(spark, sf_dir)
    rooted = stash(bank.join(roots(bank), ["language", "origin"]), "rooted")
    by = ["language", "generator"]
    queries = rooted.where("bank_row_id % 20 = 0").select(*by, F.col("bank_row_id").alias("query"), "root", F.col("human").alias("vector"))
    rows = rooted.select(*by, F.col("bank_row_id").alias("id"), "root", F.col("llm").alias("vector"))
    return pairing.nearest_other(queries, rows, by).select(*by, F.col("query").alias("human_row"), F.col("id").alias("candidate_row"), F.round("distance", 6).alias("distance"))


def pairs_leave_one_generator(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """Pairs by held-out generator: it alone on the test side, the others on the train side."""
    pairs = current_pairs(spark, sf_dir, seeds)
    held = pairs.select(F.col("generator").alias("heldout")).distinct()
    use = pairs.join(F.broadcast(held)).where("(side = 'test') = (generator = heldout)")
    return use.groupBy("language", *_seed(seeds), "heldout", F.col("fold").cast("bigint").alias("fold"), "side", F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n_pairs"), F.countDistinct("human_origin").alias("n_humans"))


def pairs_leave_one_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test pairs of all folds, by held-out language: sizes and digests that both sides hold."""
    ends = current_pairs(spark, sf_dir).where("side = 'test'").select("language", F.explode(F.array("human_sha", "candidate_sha")).alias("sha")).distinct()
    shared = ends.groupBy("sha").agg(F.count("*").alias("k")).where("k > 1")
    flags = ends.join(shared, "sha", "left").withColumn("is_shared", F.col("k").isNotNull())
    return flags.groupBy(F.col("language").alias("heldout_language")).agg(F.count("*").alias("n_digests"), F.count_if("is_shared").alias("n_shared"))


def leakage_audit(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """Per language, fold and generator: pairs, origins and digests on both sides, negatives within a component, humans without a negative (of groups without a derangement), repeated pairs. All leakage counts must be 0."""
    pairs = stash(current_pairs(spark, sf_dir, seeds), "pairs")
    by = ["language", *_seed(seeds), "fold", "generator"]

    def on_both_sides(a: str, b: str, name: str) -> DataFrame:
        ends = pairs.select(*by, "side", F.explode(F.array(a, b)).alias("x")).groupBy(*by, "x").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        return ends.groupBy(*by).agg(F.count_if(F.expr("lo <> hi")).alias(name))

    rows = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(F.expr("label = 0 and human_root = candidate_root")).alias("component_violations"), (F.count_if(F.expr("label = 1")) - F.count_if(F.expr("label = 0"))).alias("missing_negatives"))
    distinct = pairs.groupBy(*by, "side", "label", "human_origin", "candidate_origin").agg(F.count("*").alias("k")).groupBy(*by).agg(F.sum(F.col("k") - 1).alias("repeated_pairs"))
    out = rows.join(distinct, by).join(on_both_sides("human_origin", "candidate_origin", "endpoint_leakage"), by).join(on_both_sides("human_sha", "candidate_sha", "content_leakage"), by)
    return out.withColumn("fold", F.col("fold").cast("bigint"))


def split_metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by generator and label for every side, zeros included."""
    pairs = current_pairs(spark, sf_dir)
    counts = pairs.groupBy("language", F.col("fold").cast("bigint").alias("fold"), "side", "generator").agg(F.count_if(F.expr("label = 0")).alias("n_negative"), F.count_if(F.expr("label = 1")).alias("n_positive"), F.countDistinct("human_root").alias("n_components"))
    return counts


def pair_spec_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and origins on train and on another side of pair_spec, any role; origins within a language, digests in any."""
    pairs = table(spark, sf_dir, "pair_spec").where("side is not null")
    seen = F.when(F.col("side") == "train", 1).otherwise(0)
    digests = pairs.select(seen.alias("t"), F.explode(F.array(norm_digest(F.col("human_code_sha256")), norm_digest(F.col("candidate_code_sha256")))).alias("x"), F.lit("digest").alias("kind"), F.lit("").alias("scope"))
    origins = pairs.select(seen.alias("t"), F.explode(F.array(norm_origin(F.col("human_origin_id")), norm_origin(F.col("candidate_origin_id")))).alias("x"), F.lit("origin").alias("kind"), F.col("language").alias("scope"))
    both = digests.unionByName(origins).where("x is not null and scope is not null").groupBy("kind", "scope", "x").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return both.groupBy("kind").agg(F.count("*").alias("n_values"), F.count_if(F.expr("lo <> hi")).alias("n_shared"))


QUERIES = {
    f.__name__: f
    for f in (
        bank_first_k, complete_group_sample, bank_completeness, content_edges, bank_components, component_order, fold_assignment,
        hash_order_positions, derangement_offset, negatives_current, negatives_random, negatives_hard, pairs_leave_one_generator,
        pairs_leave_one_language, leakage_audit, split_metadata_counts, pair_spec_leakage,
    )
}


def _of_all_seeds(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, SEEDS)

    run.__name__ = f"{f.__name__}_seeds"
    return run


#: The same over all three seeds, with the seed as a column.
_SEEDED = (fold_assignment, hash_order_positions, derangement_offset, negatives_current, negatives_random, pairs_leave_one_generator, leakage_audit)
QUERIES |= {f"{f.__name__}_seeds": _of_all_seeds(f) for f in _SEEDED}


def _d(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '^\\s*(sha256:)?\\s*|\\s+$', '', 'g'), '')"


def _o(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower({c}), '\\', '/'), '^\\s+|\\s+$', '', 'g'), '/+', '/', 'g'), '^(\\./)+', ''), '')"


_CLEAN = f"""
raw as (
  select bank_row_id, language, {_o("human_origin_id")} as origin, llm_source as generator, {_d("human_code_sha256")} as human_sha, {_d("candidate_code_sha256")} as candidate_sha, human, llm
  from feature_bank where label = 1
), clean as (
  select * from raw where language is not null and origin is not null and generator is not null and human_sha is not null and candidate_sha is not null and human is not null and llm is not null
  qualify row_number() over (partition by language, origin, generator order by bank_row_id) = 1
)"""
_BANK = f"""{_CLEAN}, bank as (
  select * from clean where (language, origin) in (select (language, origin) from clean group by language, origin having count(*) = (select count(distinct generator) from clean))
), members as (select distinct language, origin, unnest([human_sha, candidate_sha]) as sha from bank)"""
_ROOTS = f"""{_BANK}, reach(language, origin, g) as (
  select distinct language, origin, origin from members
  union
  select b.language, b.origin, r.g from reach r join members a on a.language = r.language and a.origin = r.origin join members b on b.language = a.language and b.sha = a.sha
), roots as (select language, origin, min(g) as root from reach group by language, origin),
comps as (select language, root, count(*) as size, sha256('{SEED}|' || language || '|' || root) as tie from roots group by language, root)"""
_FOLDS = f"""{_ROOTS}, ranked as (select *, row_number() over (partition by language order by size desc, tie, root) as rn from comps),
lpt(language, root, rn, fold, loads) as (
  select language, root, rn, 0::bigint, [size, 0, 0, 0, 0]::bigint[] from ranked where rn = 1
  union all
  select k.language, k.root, k.rn, (list_position(l.loads, list_min(l.loads)) - 1)::bigint,
    list_transform(l.loads, lambda x, i: x + case when i = list_position(l.loads, list_min(l.loads)) then k.size else 0 end)
  from lpt l join ranked k on k.language = l.language and k.rn = l.rn + 1
), folds as (select r.language, r.origin, r.root, l.fold from roots r join lpt l using (language, root))"""
_PLACED = f"""{_FOLDS}, members2 as (
  select b.language, {SEED} as seed, x.fold, case when x.fold = f.fold then 'test' else 'train' end as side, b.generator, b.origin, f.root, b.human_sha, b.candidate_sha
  from bank b join folds f using (language, origin) cross join (select unnest(range(5)) as fold) x
), placed as (
  select *, row_number() over (partition by language, fold, side, generator order by sha256(language || '|' || seed || '|' || fold || '|' || side || '|' || generator || '|' || origin), origin) - 1 as pos,
    count(*) over (partition by language, fold, side, generator) as n
  from members2
)"""
_OFFSETS = f"""{_PLACED}, bad as (
  select distinct a.language, a.fold, a.side, a.generator, ((b.pos - a.pos) % a.n + a.n) % a.n as d
  from placed a join placed b on a.language = b.language and a.fold = b.fold and a.side = b.side and a.generator = b.generator and a.root = b.root and a.origin <> b.origin
), groups as (select distinct language, fold, side, generator, n from placed), tried as (select g.*, unnest(range(1, n)) as d from groups g),
offsets as (
  select g.language, g.fold, g.side, g.generator, min(t.d) filter (bad.d is null) as "offset" from groups g
  left join tried t on g.language = t.language and g.fold = t.fold and g.side = t.side and g.generator = t.generator
  left join bad on bad.language = t.language and bad.fold = t.fold and bad.side = t.side and bad.generator = t.generator and bad.d = t.d
  group by all
), negatives as (
  select a.language, a.fold, a.side, a.generator, a.origin as human_origin, b.origin as candidate_origin, a.human_sha, b.candidate_sha, a.root as human_root, b.root as candidate_root
  from placed a join offsets o using (language, fold, side, generator)
  join placed b on b.language = a.language and b.fold = a.fold and b.side = a.side and b.generator = a.generator and b.pos = (a.pos + o."offset") % a.n
), pairs as (
  select language, fold, side, generator, human_origin, candidate_origin, human_sha, candidate_sha, human_root, candidate_root, 0::bigint as label from negatives
  union all
  select language, fold, side, generator, origin, origin, human_sha, candidate_sha, root, root, 1 from placed
)"""
_START = """
tries as (
  select p.*, ('0x' || substr(sha256('random|' || language || '|' || seed || '|' || fold || '|' || side || '|' || generator || '|' || origin), 1, 12))::bigint % n as start from placed p
), steps as (select t.*, unnest(range(n)) as step from tries t)"""


def _q(ctes: str, body: str) -> str:
    return f"with recursive {ctes} {body}"


_RING = "select t.language, t.fold, t.side, t.generator, t.origin as human_origin, min_by(c.origin, t.step) as candidate_origin from steps t join placed c on c.language = t.language and c.fold = t.fold and c.side = t.side and c.generator = t.generator and c.pos = (t.start + t.step) % t.n where c.root <> t.root group by 1, 2, 3, 4, 5"
_BOTH = """select language, fold, generator, count(*) filter (lo <> hi) as k from (
  select language, fold, generator, x, min(side) as lo, max(side) as hi from (select language, fold, generator, side, unnest([{0}, {1}]) as x from pairs) group by 1, 2, 3, 4) group by 1, 2, 3"""

ORACLE = {
    "bank_first_k": _q(_CLEAN, f"select bank_row_id, language, origin, generator, place from clean join (select language, origin, row_number() over (partition by language order by origin) as place from (select distinct language, origin from clean)) using (language, origin) where place <= {FIRST_K}"),
    "complete_group_sample": _q(_CLEAN, "select language, origin, first_row, n_rows from (select *, sum(n_rows) over (order by first_row) as running, row_number() over (order by first_row) as place from (select language, origin, min(bank_row_id) as first_row, count(*) as n_rows from clean group by 1, 2)) where running - n_rows < 200 or place <= 3"),
    "bank_completeness": f"""with r as (select language, {_o("human_origin_id")} as origin, llm_source as generator from feature_bank where label = 1 and language is not null and llm_source is not null),
      t as (select language, origin, generator, count(*) as n_rows from r where origin is not null group by 1, 2, 3),
      w as (select * from (select distinct language, origin from t) cross join (select distinct generator from t))
      select w.language, w.generator, count(*) filter (n_rows is null) as missing, count(*) filter (n_rows > 1) as repeated, count(*) as expected from w left join t using (language, origin, generator) group by 1, 2""",
    "content_edges": _q(_BANK, "select language, sha, origin, least from (select *, min(origin) over (partition by language, sha) as least from members) where origin <> least"),
    "bank_components": _q(_ROOTS, "select language, origin, root from roots"),
    "component_order": _q(_ROOTS, "select language, root, size, row_number() over (partition by language, size order by tie, root) - 1 as place from comps"),
    "fold_assignment": _q(_FOLDS, "select language, origin, root, fold from folds"),
    "hash_order_positions": _q(_PLACED, "select language, fold, side, generator, origin, pos, n from placed"),
    "derangement_offset": _q(_OFFSETS, 'select language, fold, side, generator, "offset", case when "offset" is null then \'no derangement\' else \'ok\' end as status from offsets'),
    "negatives_current": _q(_OFFSETS, "select language, fold, side, generator, human_origin, candidate_origin from negatives"),
    "negatives_random": _q(f"{_PLACED}, {_START}", _RING),
    "negatives_hard": _q(_ROOTS, """, rooted as (select * from bank join roots using (language, origin)), d as (
      select a.language, a.generator, a.bank_row_id as human_row, b.bank_row_id as candidate_row, list_distance(a.human, b.llm) as distance
      from rooted a join rooted b on a.language = b.language and a.generator = b.generator and a.root <> b.root where a.bank_row_id % 20 = 0)
      select language, generator, human_row, candidate_row, round(distance, 6) as distance from d qualify row_number() over (partition by language, generator, human_row order by distance, candidate_row) = 1"""),
    "pairs_leave_one_generator": _q(_OFFSETS, "select p.language, h.heldout, p.fold, p.side, p.label, count(*) as n_pairs, count(distinct human_origin) as n_humans from pairs p cross join (select distinct generator as heldout from bank) h where (p.side = 'test') = (p.generator = h.heldout) group by 1, 2, 3, 4, 5"),
    "pairs_leave_one_language": _q(_OFFSETS, ", ends as (select distinct language, unnest([human_sha, candidate_sha]) as sha from pairs where side = 'test') select language as heldout_language, count(*) as n_digests, count(*) filter (k > 1) as n_shared from (select *, count(*) over (partition by sha) as k from ends) group by 1"),
    "leakage_audit": _q(_OFFSETS, f""", a as (select language, fold, generator, count(*) as n_pairs, count(*) filter (label = 0 and human_root = candidate_root) as component_violations, count(*) filter (label = 1) - count(*) filter (label = 0) as missing_negatives,
        count(*) - count(distinct (side, label, human_origin, candidate_origin)) as repeated_pairs from pairs group by 1, 2, 3),
      e as ({_BOTH.format("human_origin", "candidate_origin")}), c as ({_BOTH.format("human_sha", "candidate_sha")})
      select language, fold, generator, n_pairs, component_violations, missing_negatives, repeated_pairs, e.k as endpoint_leakage, c.k as content_leakage from a join e using (language, fold, generator) join c using (language, fold, generator)"""),
    "split_metadata_counts": _q(_OFFSETS, "select language, fold, side, generator, count(*) filter (label = 0) as n_negative, count(*) filter (label = 1) as n_positive, count(distinct human_root) as n_components from pairs group by 1, 2, 3, 4"),
    "pair_spec_leakage": f"""with p as (select side = 'train' as t, language, {_d("human_code_sha256")} as hd, {_d("candidate_code_sha256")} as cd, {_o("human_origin_id")} as ho, {_o("candidate_origin_id")} as co from pair_spec where side is not null),
      v as (select t, 'digest' as kind, '' as scope, unnest([hd, cd]) as x from p union all select t, 'origin', language, unnest([ho, co]) from p)
      select kind, count(*) as n_values, count(*) filter (lo <> hi) as n_shared from (select kind, scope, x, min(t) as lo, max(t) as hi from v where x is not null and scope is not null group by 1, 2, 3) group by 1""",
}
