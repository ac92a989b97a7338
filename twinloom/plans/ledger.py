"""Ledgers of fold results, their summaries and decision gates, as SQL that both engines run.

The ledger is made of the events table: an event type but ``error`` is a language
(four are left, as the gates ask; ``error`` events are in none of the results), a user's
rest by 3 a seed, an event's rest by 5 a fold, then method, hold-out and
condition; a cell's score is its mean value scaled to at most 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinloom.sources.tables import table

_AXES = """
  event_type as language, case user_id % 3 when 0 then 42 when 1 then 123 else 2024 end as seed, event_id % 5 as fold,
  case when floor(event_id / 5) % 2 = 0 then 'baseline' else 'candidate' end as method,
  cast(floor(event_id / 10) as bigint) % 4 as holdout, cast(floor(event_id / 40) as bigint) % 6 as cond, cast(floor(event_id / 5) as bigint) % 6 as variant"""
_ROWS = f"keyed as (select {_AXES}, value, event_id from events where event_type is not null and event_type <> 'error' and user_id is not null and event_id is not null and value is not null)"


def _cells(*keys: str) -> str:
    return f"{_ROWS}, cells as (select {', '.join(keys)}, least(1e0, avg(value) / 5e2) as f1, count(*) as n from keyed group by {', '.join(keys)})"


_A = _cells("language", "seed", "fold", "method")
_B = _cells("language", "holdout", "seed", "fold", "method")
_C = _cells("language", "seed", "fold", "method", "cond")
_V = _cells("language", "seed", "fold", "variant")
_DELTA = "paired as (select c.language, c.seed, c.fold, c.f1 - b.f1 as delta from cells c join cells b on b.language = c.language and b.seed = c.seed and b.fold = c.fold where c.method = 'candidate' and b.method = 'baseline')"
_SEEDS = "seeds as (select language, seed, avg(delta) as delta from paired group by language, seed)"
_LANG = "by_language as (select language, avg(delta) as delta from paired group by language)"
_MEAN_SD = "round(avg({0}), 6) as mean_{1}, round(coalesce(stddev_samp({0}), 0e0), 6) as sd_{1}"
_RATE = "(values ('A', 0, -5e-3, 3, -1e-2), ('A-relaxed', 0, -1e-2, 3, -15e-3)) as t(gate, k, least_mean, least_won, least_worst)"

SQL = {
    "ledger_coverage": f"""with {_B}, axes as (select * from (select distinct language from cells) a cross join (select distinct holdout from cells) b cross join (select distinct seed from cells) c cross join (select distinct fold from cells) d cross join (select distinct method from cells) e)
      select a.language, a.method, count(*) as expected, count(c.n) as there, count(*) - count(c.n) as missing from axes a left join cells c on c.language = a.language and c.holdout = a.holdout and c.seed = a.seed and c.fold = a.fold and c.method = a.method group by a.language, a.method""",
    "ledger_duplicates": f"with {_ROWS} select language, seed, fold, method, holdout, cond, count(*) as n_rows from keyed group by language, seed, fold, method, holdout, cond having count(*) > 1",
    "ledger_resume_anti": f"with {_B}, finished as (select * from cells where seed = 42 or fold < 2) select c.language, c.holdout, c.seed, c.fold, c.method from cells c where not exists (select 1 from finished d where d.language = c.language and d.holdout = c.holdout and d.seed = c.seed and d.fold = c.fold and d.method = c.method)",
    "cell_mean_sd": f"with {_A} select language, method, {_MEAN_SD.format('f1', 'f1')}, count(*) as n_folds from cells group by language, method",
    "macro_language_mean_sd": f"with {_A}, macro as (select seed, fold, method, avg(f1) as f1 from cells group by seed, fold, method) select method, {_MEAN_SD.format('f1', 'f1')}, count(*) as n_cells from macro group by method",
    "paired_delta": f"with {_A}, {_DELTA} select language, {_MEAN_SD.format('delta', 'delta')}, count(*) as n_pairs from paired group by language",
    "seed_cluster_ci": f"""with {_A}, {_DELTA}, {_SEEDS}, draws as (select a.language, (a.delta + b.delta + c.delta) / 3e0 as m from seeds a join seeds b on b.language = a.language join seeds c on c.language = a.language)
      select language, round(percentile_disc(0.025) within group (order by m), 6) as low, round(avg(m), 6) as mean, round(percentile_disc(0.975) within group (order by m), 6) as high, count(*) as n_draws from draws group by language""",
    "direction_counts": f"with {_A}, {_DELTA}, {_SEEDS} select language, count(*) filter (where delta > 0) as n_up, count(*) filter (where delta = 0) as n_same, count(*) filter (where delta < 0) as n_down from seeds group by language",
    "seed_macro_deltas": f"with {_A}, {_DELTA}, {_SEEDS}, m as (select seed, avg(delta) as delta from seeds group by seed) select seed, round(delta, 6) as delta, case when delta >= 0 then 1 else 0 end as not_worse from m",
    "clean_to_attack_drop": f"""with {_C}, drops as (select a.language, a.method, a.cond, c.f1 as clean_f1, c.f1 - a.f1 as loss from cells a join cells c on c.language = a.language and c.seed = a.seed and c.fold = a.fold and c.method = a.method and c.cond = 0)
      select language, method, cond, {_MEAN_SD.format('loss', 'loss')}, round(avg(loss) / nullif(avg(clean_f1), 0e0), 6) as relative_loss, count(*) as n_cells from drops group by language, method, cond""",
    "drop_reduction": f"""with {_C}, drops as (select a.method, a.cond, avg(c.f1 - a.f1) as loss from cells a join cells c on c.language = a.language and c.seed = a.seed and c.fold = a.fold and c.method = a.method and c.cond = 0 group by a.method, a.cond)
      select b.cond, round(b.loss, 6) as baseline_loss, round(c.loss, 6) as candidate_loss, round(case when b.loss > 0 then (b.loss - c.loss) / b.loss end, 6) as reduction from drops b join drops c on c.cond = b.cond where b.method = 'baseline' and c.method = 'candidate'""",
    "candidate_ranking": f"with {_V}, m as (select variant, avg(f1) as f1 from cells group by variant) select variant, round(f1, 6) as f1, cast(row_number() over (order by f1 desc, variant) as bigint) as place from m",
    "gate_a": f"""with {_A}, {_DELTA}, {_LANG}, s as (select avg(delta) as m, min(delta) as worst, count(*) filter (where delta >= 0) as won from by_language)
      select t.gate, round(m, 6) as mean_delta, won as n_won, round(worst, 6) as worst, m >= least_mean and won >= least_won and worst >= least_worst as passed from s cross join {_RATE}""",
    "gate_b": f"""with {_B}, h as (select c.holdout, avg(c.f1 - b.f1) as delta from cells c join cells b on b.language = c.language and b.holdout = c.holdout and b.seed = c.seed and b.fold = c.fold where c.method = 'candidate' and b.method = 'baseline' group by c.holdout),
      s as (select avg(delta) as m, count(*) filter (where delta > 0) as won from h) select round(m, 6) as mean_delta, won as n_won, won >= 3 and m >= 3e-2 as passed, won >= 3 and m > 0 as passed_relaxed from s""",
    "gate_c": f"""with {_C}, drops as (select a.method, avg(a.f1) as f1, avg(c.f1 - a.f1) as loss from cells a join cells c on c.language = a.language and c.seed = a.seed and c.fold = a.fold and c.method = a.method and c.cond = 0 where a.cond = 5 group by a.method),
      s as (select c.f1 - b.f1 as advantage, case when b.loss > 0 then (b.loss - c.loss) / b.loss end as reduction from drops b cross join drops c where b.method = 'baseline' and c.method = 'candidate')
      select round(advantage, 6) as advantage, round(reduction, 6) as reduction, advantage > 0 and (advantage >= 5e-2 - 1e-12 or coalesce(reduction >= 3e-1 - 1e-12, false)) as passed from s""",
    "gate_d": f"""with {_A}, {_DELTA}, {_LANG}, s as (select avg(delta) as m, count(*) filter (where delta > 0) as won from by_language)
      select round(m, 6) as mean_delta, won as n_won, won >= 3 and m >= 2e-2 - 1e-12 as passed, won >= 3 and m >= 3e-2 - 1e-12 as passed_stronger from s""",
    "gate_evaluable": f"""with {_B}, s as (select count(distinct language) as languages, count(distinct seed) as seeds, count(distinct fold) as folds, count(distinct holdout) as holdouts, count(*) as n_cells from cells)
      select languages, seeds, folds, holdouts, n_cells, case when languages <> 4 then 'languages' when seeds <> 3 then 'seeds' when folds <> 5 then 'folds' when holdouts <> 4 then 'holdouts' when n_cells <> 480 then 'cells' else '' end as reason from s""",
    "negative_mode_summary": """with p as (select coalesce(negative_pair_mode, 'positive') as mode, language, case when human_component_id = candidate_component_id then 1e0 else 0e0 end as same from pair_spec where language is not null)
      select mode, coalesce(language, 'all') as language, count(*) as n_pairs, round(avg(same), 6) as same_component from p group by grouping sets ((mode), (mode, language))""",
    "ablation_contrasts": f"""with {_V}, pairs as (select t.contrast, c.language, c.seed, c.f1 - b.f1 as delta from (values ('C1', 1, 0), ('C2', 2, 0), ('C3', 4, 1), ('C4', 5, 4), ('C5', 5, 0)) as t(contrast, hi, lo)
        join cells c on c.variant = t.hi join cells b on b.variant = t.lo and b.language = c.language and b.seed = c.seed and b.fold = c.fold)
      select contrast, coalesce(language, 'all') as language, round(avg(delta), 6) as mean_delta, round(coalesce(stddev_samp(delta), 0e0), 6) as sd_delta, count(*) as n_pairs from pairs group by grouping sets ((contrast), (contrast, language))""",
    "ablation_cell_validation": f"""with {_V}, c as (select language, seed, fold, count(*) as n_variants, min(f1) as lo, max(f1) as hi from cells group by language, seed, fold)
      select language, count(*) as n_cells, count(*) filter (where n_variants <> 6) as incomplete, count(*) filter (where lo < 0 or hi > 1) as out_of_range from c group by language""",
    "status_rollup": f"""with {_V}, c as (select language, seed, fold, count(*) as k, min(f1) as lo from cells group by language, seed, fold), s as (select language, max(case when lo < 5e-2 then 2 when k <> 6 then 1 else 0 end) as worst from c group by language)
      select language, case worst when 2 then 'FAIL' when 1 then 'BLOCKED' else 'PASS' end as status from s""",
    "sha_format": """with d as (select 'bank' as source, human_code_sha256 as x from feature_bank union all select 'bank', candidate_code_sha256 from feature_bank union all select 'pair', human_code_sha256 from pair_spec union all select 'pair', candidate_code_sha256 from pair_spec)
      select source, count(*) as n_values, count(*) filter (where x is null) as n_null, count(*) filter (where length(x) <> 64 or x <> lower(x) or substr(x, 1, 1) = ' ') as n_other_notation from d group by source""",
    "pair_duplicates": "select language, count(*) as n_rows, count(distinct pair_sha256) as n_distinct, count(pair_sha256) - count(distinct pair_sha256) as n_repeated from pair_spec group by language",
    "generator_label_counts": """with a as (select g.llm_source, l.label from (select distinct llm_source from pair_spec where llm_source is not null) g cross join (values (0), (1)) as l(label))
      select a.llm_source, cast(a.label as bigint) as label, count(p.pair_id) as n_pairs from a left join pair_spec p on p.llm_source = a.llm_source and p.label = a.label group by a.llm_source, a.label""",
    "pair_role_counts": """with e as (select llm_source, human_component_id as c, human_origin_id as o from pair_spec union all select llm_source, candidate_component_id, candidate_origin_id from pair_spec)
      select llm_source, count(distinct c) as n_components, count(distinct o) as n_origins, count(*) as n_ends from e group by llm_source""",
    "late_deliveries": "select language, count(*) as n_rows, count(*) filter (where loaded_at > built_at + interval '7' day) as n_late from pair_spec group by language",
    "pair_bank_lookup": """with p as (select p.pair_id, p.label, h.language as h_language, c.language as c_language, h.human_origin_id as h_origin, c.candidate_origin_id as c_origin, p.human_positive_row_idx as hi, p.candidate_positive_row_idx as ci
        from pair_spec p left join feature_bank h on h.bank_row_id = p.human_positive_row_idx left join feature_bank c on c.bank_row_id = p.candidate_positive_row_idx)
      select cast(label as bigint) as label, count(*) as n_pairs, count(h_origin) as n_human, count(c_origin) as n_candidate, count(*) filter (where h_origin = c_origin) as n_same_origin, count(*) filter (where hi is null or ci is null) as n_unresolved from p group by label""",
}

# cell means lie on a decimal grid, so sums in another order would flip ties: results are rounded just off them
SQL = {name: text.replace(", 6)", " + 3e-10, 6)") for name, text in SQL.items()}

_TABLES = ("events", "pair_spec", "feature_bank")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = SQL[name]
    used = [t for t in _TABLES if f" {t}" in text]
    for t in used:  # tables are arguments of the statement, so that no view of the caller is replaced
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in SQL}
ORACLE = dict(SQL)
