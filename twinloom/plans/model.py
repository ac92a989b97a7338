"""Representations, scaling, models, importance and record digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.operators import measure, model
from twinloom.operators.ranking import hash_positions
from twinloom.plans.bank import complete_bank, current_pairs
from twinloom.plans.code import binary_scores
from twinloom.runtime import stash
from twinloom.sources.tables import table

BLOCKS = ("human_absolute", "candidate_absolute", "delta", "relative_delta")
FAMILIES = (("original_style", 0, 10), ("lexical", 10, 16), ("structural_syntax", 16, 24), ("formatting_layout", 24, 28))
WIDTH = 28
TOP_K = 10
#: Registered display values of the number audit.
REGISTERED = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0)


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_spec rows whose two ends are in the bank, with both vectors."""
    bank = table(spark, sf_dir, "feature_bank")
    pairs = table(spark, sf_dir, "pair_spec").select("pair_id", "label", "language", "side", "human_positive_row_idx", "candidate_positive_row_idx")
    human = bank.select(F.col("bank_row_id").alias("human_positive_row_idx"), "human").where("human is not null")
    candidate = bank.select(F.col("bank_row_id").alias("candidate_positive_row_idx"), "llm").where("llm is not null")
    return pairs.join(human, "human_positive_row_idx").join(candidate, "candidate_positive_row_idx")


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each block of the full representation, by pair."""
    full = measure.representation(F.col("human"), F.col("llm"), "full")
    total = lambda i: F.round(F.aggregate(F.slice("x", i * WIDTH + 1, WIDTH), F.lit(0.0), lambda a, v: a + v), 4)
    return pair_vectors(spark, sf_dir).select("pair_id", full.alias("x")).select("pair_id", *(total(i).alias(b) for i, b in enumerate(BLOCKS[:3])), F.size("x").cast("bigint").alias("width"))


def ablation_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each ablation variant's representation, as built from the data."""
    rows = pair_vectors(spark, sf_dir)
    widths = rows.agg(*(F.max(F.size(measure.variant(F.col("human"), F.col("llm"), v))).cast("bigint").alias(v) for v in measure.VARIANTS))
    return widths.unpivot([], list(measure.VARIANTS), "variant", "width")


def scaler_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and coordinate of the delta: the train side's mean and deviation, and the test side's mean once scaled by them."""
    rows = pair_vectors(spark, sf_dir).where("side in ('train', 'test') and language is not null").select("language", "side", measure.representation(F.col("human"), F.col("llm"), "delta").alias("x"))
    stats = model.column_stats(rows.where("side = 'train'"), "x", WIDTH, ["language"])
    test = model.column_stats(rows.where("side = 'test'"), "x", WIDTH, ["language"]).select("language", F.col("mean").alias("test"))
    both = stats.join(test, "language").select("language", F.posexplode(F.arrays_zip("mean", "sd", "test")).alias("coord", "v"))
    spread = F.when(F.col("v.sd") > 0, F.col("v.sd")).otherwise(1.0)
    return both.select("language", F.col("coord").cast("bigint").alias("coord"), F.round("v.mean", 4).alias("mean"), F.round("v.sd", 4).alias("sd"), F.round((F.col("v.test") - F.col("v.mean")) / spread, 4).alias("scaled_test_mean"))


def _fold_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the constructed folds with the concat_delta representation of the ten style measurements."""
    bank = stash(complete_bank(spark, sf_dir).select("language", "origin", "generator", "human", "llm"), "vectors")
    pairs = current_pairs(spark, sf_dir).select("language", "fold", "side", "generator", "human_origin", "candidate_origin", "label")
    human = bank.select("language", "generator", F.col("origin").alias("human_origin"), "human")
    candidate = bank.select("language", "generator", F.col("origin").alias("candidate_origin"), "llm")
    joined = pairs.join(human, ["language", "generator", "human_origin"]).join(candidate, ["language", "generator", "candidate_origin"])
    return stash(joined.select("language", "fold", "side", "generator", "human_origin", "label", measure.variant(F.col("human"), F.col("llm"), "A1").alias("x")), "pair-vectors")


def _scored_folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    rows = _fold_vectors(spark, sf_dir)
    width = measure.VARIANTS["A1"][0] * 3
    out, fitted = [], {}
    for fold in range(5):
        train, test = rows.where((F.col("fold") == fold) & (F.col("side") == "train")), rows.where((F.col("fold") == fold) & (F.col("side") == "test"))
        stats = stash(model.column_stats(train, "x", width, []), "stats")
        fitted[fold] = model.fit(model.scaled(train, stats, "x", []))
        out.append(model.score(fitted[fold], model.scaled(test, stats, "x", [])))
    return reduce(DataFrame.unionByName, out), fitted


def classifier_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a logistic model by fold and language, scaled and fitted on the train side alone."""
    scored, _ = _scored_folds(spark, sf_dir)
    return binary_scores(model.confusion(scored, ["fold", "language"]))


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop of F1 by fold when one coordinate of the test rows is taken from the next row in a hash order.

    The model is linear, so every coordinate's permuted score comes from the row
    and its partner at once, in one aggregation.
    """
    scored, fitted = _scored_folds(spark, sf_dir)
    rows = scored.withColumn("digest", F.sha2(F.concat_ws("|", "language", "generator", "human_origin", "label"), 256))
    placed = stash(hash_positions(rows, ["fold"], "digest", "digest"), "placed")
    partner = placed.select("fold", F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("x").alias("other"))
    both = placed.join(partner, ["fold", "pos"])
    weights = spark.createDataFrame([(f, [float(v) for v in m.coefficients], float(m.intercept)) for f, m in fitted.items()], "fold int, w array<double>, b double")
    joined = both.join(F.broadcast(weights), "fold")
    plain = F.aggregate(F.zip_with("x", "w", lambda x, w: x * w), F.col("b"), lambda a, v: a + v)
    moved = F.zip_with(F.zip_with("other", "x", lambda o, x: o - x), F.col("w"), lambda d, w: d * w)
    base = joined.select("fold", (F.col("label") == 1).alias("y"), plain.alias("s"), F.concat(F.array(F.lit(0.0)), moved).alias("moves"))
    flat = base.select("fold", "y", "s", F.posexplode("moves").alias("coord", "move"))
    hit = F.col("s") + F.col("move") > 0
    c = flat.groupBy("fold", "coord").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"), F.count_if(~hit & ~F.col("y")).alias("tn"))
    f1 = binary_scores(c).select("fold", "coord", "f1")
    whole = f1.where("coord = 0").select("fold", F.col("f1").alias("plain_f1"))
    return f1.where("coord > 0").join(whole, "fold").select("fold", (F.col("coord") - 1).alias("coord"), F.round(F.col("plain_f1") - F.col("f1"), 6).alias("f1_drop"))


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(language, fold, coord, gain)``: share of a coordinate in the fold's total of absolute values of the first three blocks (0 if that is 0)."""
    bank = table(spark, sf_dir, "feature_bank").where("human is not null and llm is not null and language is not null")
    x = measure.representation(F.col("human"), F.col("llm"), "concat_delta")
    rows = bank.select("language", (F.col("bank_row_id") % 5).alias("fold"), x.alias("x"))
    sums = rows.groupBy("language", "fold").agg(F.array(*(F.sum(F.abs(F.element_at("x", i + 1))) for i in range(3 * WIDTH))).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, v: a + v)
    return sums.select("language", "fold", total.alias("total"), F.posexplode("g").alias("coord", "g")).select("language", "fold", "coord", F.when(F.col("total") > 0, F.col("g") / F.col("total")).otherwise(0.0).alias("gain"))


def importance_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gains(spark, sf_dir).groupBy("language", F.col("coord").cast("bigint").alias("coord"))
    return g.agg(F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.stddev_pop("gain"), 6).alias("sd_gain"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b * WIDTH + i, block, family) for b, block in enumerate(BLOCKS[:3]) for family, lo, hi in FAMILIES for i in range(lo, hi)]
    groups = spark.createDataFrame(rows, "coord int, block string, family string")
    return _gains(spark, sf_dir).join(F.broadcast(groups), "coord").groupBy("language", "fold", "block", "family").agg(F.sum("gain").alias("gain"))


def importance_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).groupBy("language", "block", "family").agg(F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.stddev_pop("gain"), 6).alias("sd_gain"))


def leading_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of the greatest mean gain by language, the first by name on ties."""
    means = _grouped(spark, sf_dir).groupBy("language", "block", "family").agg(F.round(F.avg("gain"), 6).alias("gain"))
    best = means.groupBy("language").agg(F.min(F.struct((-F.col("gain")).alias("key"), "block", "family", "gain")).alias("m"))
    return best.select("language", "m.block", "m.family", F.col("m.gain").alias("mean_gain"))


def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of the TOP_K coordinates of every two folds, by language."""
    ranked = _gains(spark, sf_dir).withColumn("gain", F.round("gain", 9)).selectExpr("*", "row_number() over (partition by language, fold order by gain desc, coord) as place").where(F.col("place") <= TOP_K)
    tops = ranked.groupBy("language", "fold").agg(F.collect_set("coord").alias("top"))
    two = tops.alias("a").join(tops.alias("b"), (F.col("a.language") == F.col("b.language")) & (F.col("a.fold") < F.col("b.fold")))
    like = F.size(F.array_intersect("a.top", "b.top")) / F.size(F.array_union("a.top", "b.top"))
    return two.select("a.language", F.col("a.fold").alias("fold_a"), F.col("b.fold").alias("fold_b"), F.round(like, 6).alias("jaccard"))


def record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each pair's canonical JSON (sorted keys, no blanks, a line end)."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    body = F.concat(F.lit('{"label":'), number("label"), F.lit(',"language":'), text("language"), F.lit(',"llm_source":'), text("llm_source"), F.lit(',"pair_id":'), number("pair_id"), F.lit("}\n"))
    return table(spark, sf_dir, "pair_spec").select("pair_id", F.sha2(body, 256).alias("record_sha256"))


def number_audit(spark: SparkSession, sf_dir: str, unit: str = "crowns") -> DataFrame:
    """Numbers of a unit in the documents by whether they lie within half a hundredth of a registered value."""
    found = F.regexp_extract_all("text", F.lit(r"(^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)?)[ \t]*" + unit), 2)
    values = table(spark, sf_dir, "documents").select(F.explode(found).alias("v")).select(F.col("v").cast("double").alias("v"))
    near = reduce(lambda a, b: a | b, [F.abs(F.col("v") - r) <= 0.005 + 1e-12 for r in REGISTERED])
    return values.groupBy(near.alias("registered")).agg(F.count("*").alias("n_values"), F.countDistinct("v").alias("n_distinct"))


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vector of another label: queries are the vectors whose id is divisible by 20, against all."""
    from twinloom.operators.pairing import nearest_other

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("root"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(0).alias("g"))
    out = nearest_other(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), e.withColumnRenamed("vec_id", "id"), ["g"])
    return out.select(F.col("query").alias("vec_id"), F.col("id").alias("nearest"), F.round("distance", 6).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (
        representations, ablation_dims, scaler_train_only, classifier_fold_scores, permutation_importance, importance_normalised,
        importance_grouped, leading_group, rank_stability, record_digest, number_audit, embedding_neighbours,
    )
}

_PAIRS = "pv as (select p.pair_id, p.language, p.side, h.human, c.llm from pair_spec p join feature_bank h on h.bank_row_id = p.human_positive_row_idx and h.human is not null join feature_bank c on c.bank_row_id = p.candidate_positive_row_idx and c.llm is not null)"
_GAINS = f"""long as (select language, bank_row_id % 5 as fold, unnest(range({WIDTH})) as i, unnest(human) as h, unnest(llm) as c from feature_bank where human is not null and llm is not null and language is not null),
s as (select language, fold, i as coord, sum(abs(h)) as g from long group by all union all select language, fold, i + {WIDTH}, sum(abs(c)) from long group by all union all select language, fold, i + {2 * WIDTH}, sum(abs(c - h)) from long group by all),
gains as (select language, fold, coord, case when sum(g) over (partition by language, fold) > 0 then g / sum(g) over (partition by language, fold) else 0.0 end as gain from s)"""
_FAMILY = "case when coord % 28 < 10 then 'original_style' when coord % 28 < 16 then 'lexical' when coord % 28 < 24 then 'structural_syntax' else 'formatting_layout' end"
_BLOCK = "case coord // 28 when 0 then 'human_absolute' when 1 then 'candidate_absolute' else 'delta' end"
_GROUPED = f"{_GAINS}, grouped as (select language, fold, {_BLOCK} as block, {_FAMILY} as family, sum(gain) as gain from gains group by all)"

ORACLE = {
    "representations": f"with {_PAIRS} select pair_id, round(list_sum(human), 4) as human_absolute, round(list_sum(llm), 4) as candidate_absolute, round(list_sum(list_transform(range(1, {WIDTH} + 1), lambda i: llm[i] - human[i])), 4) as delta, 4 * len(human) as width from pv",
    "ablation_dims": f"with {_PAIRS} select variant, k * m::bigint as width from (select max(len(human)) as n from pv) cross join (values ('A0', 10, 2), ('A1', 10, 3), ('A2', 28, 2), ('A3', 28, 1), ('A4', 28, 3), ('A5', 28, 4)) as t(variant, k, m) where n = 28",
    "scaler_train_only": f"""with {_PAIRS}, d as (select language, side, unnest(range({WIDTH})) as coord, unnest(list_transform(range(1, {WIDTH} + 1), lambda i: llm[i] - human[i])) as x from pv where side in ('train', 'test') and language is not null),
      t as (select language, coord, avg(x) as m, stddev_pop(x) as sd from d where side = 'train' group by all), e as (select language, coord, avg(x) as m from d where side = 'test' group by all)
      select t.language, t.coord, round(t.m, 4) as mean, round(t.sd, 4) as sd, round((e.m - t.m) / case when t.sd > 0 then t.sd else 1 end, 4) as scaled_test_mean from t join e using (language, coord)""",
    "importance_normalised": f"with {_GAINS} select language, coord, round(avg(gain), 6) as mean_gain, round(stddev_pop(gain), 6) as sd_gain from gains group by 1, 2",
    "importance_grouped": f"with {_GROUPED} select language, block, family, round(avg(gain), 6) as mean_gain, round(stddev_pop(gain), 6) as sd_gain from grouped group by 1, 2, 3",
    "leading_group": f"with {_GROUPED}, m as (select language, block, family, round(avg(gain), 6) as mean_gain from grouped group by 1, 2, 3) select * from m qualify row_number() over (partition by language order by mean_gain desc, block, family) = 1",
    "rank_stability": f"""with {_GAINS}, r as (select *, row_number() over (partition by language, fold order by round(gain, 9) desc, coord) as place from gains), t as (select language, fold, list(coord) as top from r where place <= {TOP_K} group by 1, 2)
      select a.language, a.fold as fold_a, b.fold as fold_b, round(len(list_intersect(a.top, b.top)) / len(list_distinct(a.top || b.top)), 6) as jaccard from t a join t b on a.language = b.language and a.fold < b.fold""",
    "record_digest": r"""with e as (select pair_id, label, '"' || replace(replace(language, '\', '\\'), '"', '\"') || '"' as l, '"' || replace(replace(llm_source, '\', '\\'), '"', '\"') || '"' as s from pair_spec)
      select pair_id, sha256('{"label":' || coalesce(label::varchar, 'null') || ',"language":' || coalesce(l, 'null') || ',"llm_source":' || coalesce(s, 'null') || ',"pair_id":' || coalesce(pair_id::varchar, 'null') || '}' || chr(10)) as record_sha256 from e""",
    "number_audit": r"with v as (select unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)?)[ \t]*crowns', 2))::double as v from documents) select "
    + " or ".join(f"abs(v - {r}) <= 0.005 + 1e-12" for r in REGISTERED)
    + " as registered, count(*) as n_values, count(distinct v) as n_distinct from v group by 1",
    "embedding_neighbours": "select a.vec_id, b.vec_id as nearest, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as distance from embeddings a join embeddings b on a.label <> b.label where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) = 1",
}
