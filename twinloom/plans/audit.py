"""Audits that must hold for a pair table, and the condition matrix of one fitted model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.operators import measure, model
from twinloom.plans.code import binary_scores
from twinloom.runtime import norm_digest, norm_origin, stash
from twinloom.sources.tables import table

# Names and patterns of the prohibited-language scan, and its negation words.
PROHIBITED = (
    ("legacy_gate_a", r"legacy\s+gate\s*a"),
    ("smoke", r"\bsmoke\b"),
    ("preflight", r"\bpreflight\b"),
    ("statistical_significance", r"statistically\s+significant"),
    ("folds_as_datasets", r"(?:folds?\s+(?:are|as)\s+independent\s+datasets|independent\s+datasets?\s+(?:are|across)\s+folds?)"),
    ("universal_claim", r"\b(?:universal|all[- ]llm|all[- ]language|attack[- ]proof)\b"),
)
NEGATION = r"\b(?:not|no|without)\b"
#: The closed language axis of the event ledger; other types are unexpected there.
LANGUAGE_AXIS = ("click", "purchase", "signup", "view")


def prohibited_language_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each prohibited pattern; a universal claim with a negation before it in its sentence doesn't count."""
    text = F.lower("text")

    def claims(pattern: str) -> F.Column:
        # where a sentence's first claim is negated, so are its later ones
        return F.exists(F.split(text, r"[.!?\n]"), lambda s: s.rlike(pattern) & ~F.split(s, pattern)[0].rlike(NEGATION))

    flags = [F.count_if(claims(p) if name == "universal_claim" else text.rlike(p)).alias(name) for name, p in PROHIBITED]
    return table(spark, sf_dir, "documents").agg(*flags).unpivot([], [n for n, _ in PROHIBITED], "pattern", "n_documents")


def completeness_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the registered axes that the ledger lacks, and cells of the ledger outside the axes, by language."""
    seeds, folds = (42, 123, 2024), range(5)
    wanted = spark.createDataFrame([(x, s, f, m) for x in LANGUAGE_AXIS for s in seeds for f in folds for m in ("baseline", "candidate")], "language string, seed int, fold bigint, method string")
    e = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null and event_id is not null")
    seed = F.when(F.col("user_id") % 3 == 0, 42).when(F.col("user_id") % 3 == 1, 123).otherwise(2024)
    method = F.when(F.floor(F.col("event_id") / 5) % 2 == 0, "baseline").otherwise("candidate")
    there = e.select(F.col("event_type").alias("language"), seed.alias("seed"), (F.col("event_id") % 5).alias("fold"), method.alias("method")).distinct()
    both = wanted.withColumn("wanted", F.lit(True)).join(there.withColumn("there", F.lit(True)), ["language", "seed", "fold", "method"], "full")
    return both.groupBy("language").agg(F.count("wanted").alias("n_expected"), F.count_if(F.isnull("there")).alias("n_missing"), F.count_if(F.isnull("wanted")).alias("n_unexpected"))


def heldout_language_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one language out: train pairs of the other languages, test pairs of the held-out one, and digests that both hold in any role, which must be none.

    Every digest is reduced to its languages by side first, so the table is read
    once whatever the number of languages.
    """
    rows = table(spark, sf_dir, "pair_spec").where("side in ('train', 'test') and language is not null")
    ends = rows.select("language", "side", F.explode(F.array(norm_digest(F.col("human_code_sha256")), norm_digest(F.col("candidate_code_sha256")))).alias("d")).where("d is not null").distinct()
    held = ends.where("side = 'test'").select(F.col("language").alias("heldout_language"), "d")
    others = ends.where("side = 'train'").groupBy("d").agg(F.collect_set("language").alias("langs"))  # one of few languages each
    shared = held.join(others, "d").where(F.exists("langs", lambda x: x != F.col("heldout_language"))).groupBy("heldout_language").agg(F.count("*").alias("n_shared"))
    sizes = rows.groupBy("language").agg(F.count_if(F.expr("side = 'test'")).alias("n_test"), F.count_if(F.expr("side = 'train'")).alias("own_train"))
    total = rows.agg(F.count_if(F.expr("side = 'train'")).alias("all_train"))
    out = sizes.join(F.broadcast(total)).withColumnRenamed("language", "heldout_language").join(shared, "heldout_language", "left")
    n = F.coalesce("n_shared", F.lit(0).cast("bigint"))
    return out.select("heldout_language", (F.col("all_train") - F.col("own_train")).alias("n_train"), "n_test", n.alias("n_shared"), F.when(n > 0, "overlap").otherwise("ok").alias("status"))


def pairing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By negative mode: whether all positives join an origin to itself, all negatives cross components and origins, and no end lacks a digest."""
    p = table(spark, sf_dir, "pair_spec")
    mode = F.coalesce("negative_pair_mode", F.lit("positive"))
    same_origin = norm_origin(F.col("human_origin_id")) == norm_origin(F.col("candidate_origin_id"))
    same_part = F.col("human_component_id") == F.col("candidate_component_id")
    positive = F.col("label") == 1
    return p.groupBy(mode.alias("mode")).agg(
        F.count("*").alias("n_pairs"),
        F.coalesce(F.every(F.coalesce(F.when(positive, same_origin), F.lit(True))), F.lit(True)).alias("positives_within_origin"),
        F.coalesce(F.every(F.coalesce(F.when(~positive, ~same_part), F.lit(True))), F.lit(True)).alias("negatives_cross_components"),
        F.coalesce(F.every(F.coalesce(F.when(~positive, ~same_origin), F.lit(True))), F.lit(True)).alias("negatives_cross_origins"),
        F.every(F.col("human_code_sha256").isNotNull() & F.col("candidate_code_sha256").isNotNull()).alias("digests_present"),
    )


def split_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_spec rows bound to the bank row they name: rows whose five fields (language, origin, digest, generator, label) agree with it, by language."""
    bank = table(spark, sf_dir, "feature_bank").select(
        F.col("bank_row_id").alias("human_positive_row_idx"), F.col("language").alias("b_language"), norm_origin(F.col("human_origin_id")).alias("b_origin"), norm_digest(F.col("human_code_sha256")).alias("b_digest"), F.col("llm_source").alias("b_source"), F.col("label").cast("int").alias("b_label")
    )
    p = table(spark, sf_dir, "pair_spec").select("human_positive_row_idx", "language", norm_origin(F.col("human_origin_id")).alias("origin"), norm_digest(F.col("human_code_sha256")).alias("digest"), "llm_source", "label")
    both = p.join(bank, "human_positive_row_idx", "left")
    agree = {"language": F.col("language") == F.col("b_language"), "origin": F.col("origin") == F.col("b_origin"), "digest": F.col("digest") == F.col("b_digest"), "source": F.col("llm_source") == F.col("b_source"), "label": F.col("b_label") == 1}
    everything = reduce(lambda a, b: a & b, agree.values())
    return both.groupBy("language").agg(F.count("*").alias("n_pairs"), F.count("b_label").alias("n_bound"), *(F.count_if(c).alias(f"n_{k}") for k, c in agree.items()), F.count_if(everything).alias("n_all"))


def condition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit, six conditions: a logistic model over all 28 measurements (human, candidate and delta) is fitted on clean train records and scores the test records clean and under each transform.

    Only the test candidate is transformed; a transform counts for the records whose
    candidate it changed without a parse regression, and ``reference`` is the clean
    score of just these.  Sides go by the human code's digest, so no human text is on
    both.  A candidate without an entry in the table of transforms is an error.
    """
    from pyspark.sql import DataFrame as D

    t = table(spark, sf_dir, "task1").where("human_src is not null and llm_src is not null and language is not null and label is not null")
    t = t.where(F.col("language").isin(*measure.LANGUAGES))
    rows = stash(t.select("record_id", "language", F.col("label").cast("int").alias("label"), F.sha2("human_src", 256).alias("h"), F.sha2("llm_src", 256).alias("m")), "records")
    snippets = measure.distinct_code(t, ["human_src", "llm_src"])
    cache = stash(measure.attacked(measure.distinct_code(t, ["llm_src"])), "transforms")
    keys = cache.select("language", F.col("input_sha256").alias("m")).distinct()
    if rows.join(keys, ["language", "m"], "left_anti").limit(1).count():
        raise ValueError("a candidate has no entry in the table of transforms")
    good = cache.where("changed and failure_reason is null").select("language", "attack", F.col("input_sha256").alias("m"), F.col("output_sha256").alias("a"), "code")
    texts = snippets.unionByName(good.select("language", F.col("a").alias("sha"), "code")).dropDuplicates(["language", "sha"])
    vectors = stash(measure.measured(texts).select("language", "sha", F.concat("style", "enhanced").alias("v")), "vectors")
    end = lambda key, c: vectors.select("language", F.col("sha").alias(key), F.col("v").alias(c))
    human = rows.withColumn("test", F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % 5 == 0).join(end("h", "human"), ["language", "h"])
    x = measure.representation(F.col("human"), F.col("llm"), "concat_delta").alias("x")
    clean = stash(human.join(end("m", "llm"), ["language", "m"]).select("record_id", "label", "test", "language", "m", "human", x), "clean")
    hit = clean.where("test").drop("x").join(good.select("language", "attack", "m", "a"), ["language", "m"]).join(end("a", "llm"), ["language", "a"])
    moved = stash(hit.select("record_id", "label", "attack", x), "transformed")
    reference = clean.where("test").select("record_id", "label", "x").join(moved.select("record_id", "attack"), "record_id")
    stats = stash(model.column_stats(clean.where("not test"), "x", 3 * 28, []), "stats")
    fitted = model.fit(model.scaled(clean.where("not test").select("x", "label"), stats, "x", []))
    matrix: list[D] = [
        clean.where("test").select("label", "x", F.lit("clean").alias("attack"), F.lit("clean").alias("condition")),
        reference.select("label", "x", "attack", F.lit("reference").alias("condition")),
        moved.select("label", "x", "attack", F.lit("transformed").alias("condition")),
    ]
    scored = model.score(fitted, model.scaled(reduce(D.unionByName, matrix), stats, "x", []))
    return binary_scores(model.confusion(scored, ["attack", "condition"]))


QUERIES = {f.__name__: f for f in (prohibited_language_scan, completeness_both_ways, heldout_language_overlap, pairing_audit, split_binding, condition_matrix)}

_D = "nullif(regexp_replace(lower({0}), '^\\s*(sha256:)?\\s*|\\s+$', '', 'g'), '')"
_O = "nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '\\', '/'), '^\\s+|\\s+$', '', 'g'), '/+', '/', 'g'), '^(\\./)+', ''), '')"
_CLAIM = dict(PROHIBITED)["universal_claim"]

ORACLE = {
    "prohibited_language_scan": " union all ".join(f"select '{n}' as pattern, count(*) as n_documents from documents where regexp_matches(lower(text), '{p}')" for n, p in PROHIBITED if n != "universal_claim")
    + f" union all select 'universal_claim', count(*) from documents where len(list_filter(regexp_split_to_array(lower(text), '[.!?\\n]'), lambda s: regexp_matches(s, '{_CLAIM}') and not regexp_matches(regexp_split_to_array(s, '{_CLAIM}')[1], '{NEGATION}'))) > 0",
    "completeness_both_ways": f"""with there as (select distinct event_type as language, case user_id % 3 when 0 then 42 when 1 then 123 else 2024 end as seed, event_id % 5 as fold, case when (event_id // 5) % 2 = 0 then 'baseline' else 'candidate' end as method from events where event_type is not null and user_id is not null and event_id is not null),
      wanted as (select * from (select unnest({list(LANGUAGE_AXIS)}) as language) cross join (select unnest([42, 123, 2024]) as seed) cross join (select unnest(range(5)) as fold) cross join (select unnest(['baseline', 'candidate']) as method)),
      missing as (select * from wanted except select * from there), more as (select * from there except select * from wanted), names as (select language from wanted union select language from there)
      select n.language, (select count(*) from wanted w where w.language = n.language) as n_expected, (select count(*) from missing m where m.language = n.language) as n_missing, (select count(*) from more m where m.language = n.language) as n_unexpected from names n""",
    "heldout_language_overlap": f"""with p as (select language, side, {_D.format("human_code_sha256")} as h, {_D.format("candidate_code_sha256")} as c from pair_spec where side in ('train', 'test') and language is not null),
      e as (select distinct language, side, unnest([h, c]) as d from p), l as (select distinct language from p)
      select l.language as heldout_language, (select count(*) from p where side = 'train' and p.language <> l.language) as n_train, (select count(*) from p where side = 'test' and p.language = l.language) as n_test,
        (select count(distinct d) from e where side = 'test' and e.language = l.language and d in (select d from e x where x.side = 'train' and x.language <> l.language and d is not null)) as n_shared,
        case when (select count(distinct d) from e where side = 'test' and e.language = l.language and d in (select d from e x where x.side = 'train' and x.language <> l.language and d is not null)) > 0 then 'overlap' else 'ok' end as status from l""",
    "pairing_audit": f"""with p as (select coalesce(negative_pair_mode, 'positive') as mode, label = 1 as y, {_O.format("human_origin_id")} = {_O.format("candidate_origin_id")} as so, human_component_id = candidate_component_id as sc, human_code_sha256 is not null and candidate_code_sha256 is not null as d from pair_spec)
      select mode, count(*) as n_pairs, count(*) filter (y and not so) = 0 as positives_within_origin, count(*) filter (not y and sc) = 0 as negatives_cross_components, count(*) filter (not y and so) = 0 as negatives_cross_origins, bool_and(d) as digests_present from p group by 1""",
    "split_binding": f"""with b as (select bank_row_id, language, {_O.format("human_origin_id")} as o, {_D.format("human_code_sha256")} as d, llm_source, label from feature_bank),
      p as (select human_positive_row_idx as i, language, {_O.format("human_origin_id")} as o, {_D.format("human_code_sha256")} as d, llm_source from pair_spec)
      select p.language, count(*) as n_pairs, count(b.label) as n_bound, count(*) filter (p.language = b.language) as n_language, count(*) filter (p.o = b.o) as n_origin, count(*) filter (p.d = b.d) as n_digest, count(*) filter (p.llm_source = b.llm_source) as n_source,
        count(*) filter (b.label = 1) as n_label, count(*) filter (p.language = b.language and p.o = b.o and p.d = b.d and p.llm_source = b.llm_source and b.label = 1) as n_all from p left join b on b.bank_row_id = p.i group by 1""",
}
