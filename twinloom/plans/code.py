"""Code records: scans, measurements, transforms and pair difficulty over task1 and task1_raw."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions import transforms
from twinloom.operators import measure
from twinloom.runtime import stash
from twinloom.sources.jsonl import scan_lines
from twinloom.sources.tables import table

TOKENS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\r\n\f]"
_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"


def _task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "task1")


def strict_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines by what a strict reader finds in them."""
    return scan_lines(table(spark, sf_dir, "task1_raw")).groupBy("status").agg(F.count("*").alias("n_lines"))


def normalize_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The human source of each record: human_file_name for label 0, else file_name."""
    return _task(spark, sf_dir).select("record_id", F.when(F.col("label") == 0, F.col("human_file_name")).otherwise(F.col("file_name")).alias("human_source_id"))


def code_sha_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, positives and distinct digests of both roles by language."""
    t = _task(spark, sf_dir)
    return t.groupBy("language").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.countDistinct(F.sha2("human_src", 256)).alias("n_human"),
        F.countDistinct(F.sha2("llm_src", 256)).alias("n_llm"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, language, role, text)``: both texts of each record that are there; a narrow step."""
    ends = F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"{role}_src").alias("text")) for role in ("human", "llm")))
    return _task(spark, sf_dir).select("record_id", "language", F.explode(ends).alias("e")).select("record_id", "language", "e.role", "e.text").where("text is not null")


def _runs(values: F.Column, zero: F.Column, of: Callable, first: str | int = "") -> F.Column:
    """Fold over the runs of equal values of a sorted array: ``of(state, length of run)``, from zero; no shuffle."""
    begin = F.struct(F.lit(first).alias("p"), F.lit(0).alias("n"), zero.alias("s"))
    same = lambda a, x: F.struct(a["p"].alias("p"), (a["n"] + 1).alias("n"), a["s"].alias("s"))
    other = lambda a, x: F.struct(x.alias("p"), F.lit(1).alias("n"), of(a["s"], a["n"]).alias("s"))
    return F.aggregate(F.array_sort(values), begin, lambda a, x: F.when((a["p"] == x) & (a["n"] > 0), same(a, x)).otherwise(other(a, x)), lambda a: of(a["s"], a["n"]))


def _longest_run(values: F.Column, first: str | int = "") -> F.Column:
    return _runs(values, F.lit(0), lambda s, n: F.greatest(s, n), first)


def _sum(values: F.Column) -> F.Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*def[ \t]+([A-Za-z0-9_]+)[ \t]*\("), 1)
    return _texts(spark, sf_dir).where("language = 'py'").select("record_id", "role", names.alias("names")).where(F.size("names") > 0)


def _style(name: F.Column) -> F.Column:
    from twinloom.functions.codestyle import STYLES

    out = F.lit("Other")
    for style, pattern in reversed(STYLES):
        out = F.when(name.rlike(pattern), style).otherwise(out)
    return out


def naming_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python function names by role and naming style."""
    names = _python_names(spark, sf_dir).select("role", F.explode("names").alias("name"))
    return names.groupBy("role", _style(F.col("name")).alias("style")).agg(F.count("*").alias("n_names"), F.countDistinct("name").alias("n_distinct"))


def naming_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the commonest style among each Python text's function names, and their mean length."""
    styles, n = F.transform("names", _style), F.size("names")
    chars = _sum(F.transform("names", lambda x: F.length(x).cast("double")))
    return _python_names(spark, sf_dir).select("record_id", "role", F.round(_longest_run(styles) / n, 6).alias("consistency"), F.round(chars / n, 6).alias("mean_length"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, language, role, lines)``: physical lines of both texts; a line end at the very end opens no further line."""
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    return _texts(spark, sf_dir).where("text <> ''").select("record_id", "language", "role", lines.alias("lines"))


def _body(line: F.Column) -> F.Column:
    return F.trim(F.translate(line, "\t\r\f", "   "))


def indentation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the commonest indent width of each text; 1 where nothing is indented."""

    def width(line: F.Column) -> F.Column:
        body = F.regexp_replace(line, r"^[ \t\r\f]+", "")
        counted = (body != "") & ~body.rlike(r"^(#|//|/\*|\*)") & (F.length(line) > F.length(body))
        return F.when(counted, F.length(F.replace(F.substring(line, F.lit(1), F.length(line) - F.length(body)), F.lit("\t"), F.lit("    "))))

    widths = _lines(spark, sf_dir).select("record_id", "role", F.filter(F.transform("lines", width), lambda w: w.isNotNull()).alias("w"))
    share = F.when(F.size("w") > 0, _longest_run(F.col("w"), 0) / F.size("w")).otherwise(1.0)
    return widths.select("record_id", "role", F.round(share, 6).alias("consistency"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(_ID), 0)
    return _texts(spark, sf_dir).select("record_id", "role", words.alias("w")).where(F.size("w") > 0)


def identifier_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy in bits of the words of each text (keywords and words in strings and comments too; code_vectors has that of the identifiers)."""
    # H = log2(N) - sum(n log2 n) / N, folded over the runs of the sorted words
    total = _runs(F.col("w"), F.lit(0.0), lambda s, n: s + F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0))
    n = F.size("w")
    return _words(spark, sf_dir).select("record_id", "role", F.round(F.log2(n.cast("double")) - total / n, 6).alias("entropy"))


def _mean_sd(values: F.Column) -> tuple[F.Column, F.Column]:
    """Mean and population deviation of a non-empty array of doubles, 0 of an empty one."""
    n = F.size(values)
    mean = F.when(n > 0, _sum(values) / n).otherwise(0.0)
    return mean, F.when(n > 0, F.sqrt(_sum(F.transform(values, lambda x: (x - mean) * (x - mean))) / n)).otherwise(0.0)


def identifier_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of word lengths by text."""
    sized = _words(spark, sf_dir).select("record_id", "role", F.transform("w", lambda x: F.length(x).cast("double")).alias("n"))
    mean, sd = _mean_sd(F.col("n"))
    return sized.select("record_id", "role", F.size("n").cast("bigint").alias("n_words"), F.round(mean, 6).alias("mean_length"), F.round(sd, 6).alias("sd_length"))


def format_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-line ratio, and mean and population deviation of the non-blank lines' lengths."""
    sizes = F.transform(F.filter("lines", lambda x: _body(x) != ""), lambda x: F.length(x).cast("double"))
    full = _lines(spark, sf_dir).select("record_id", "role", F.size("lines").alias("k"), sizes.alias("n"))
    mean, sd = _mean_sd(F.col("n"))
    return full.select("record_id", "role", F.round((F.col("k") - F.size("n")) / F.col("k"), 6).alias("blank_ratio"), F.round(mean, 6).alias("mean_length"), F.round(sd, 6).alias("sd_length"))


def brace_nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean nesting depth of C, C++ and Java code: running balance of braces over lines that are no comment."""
    kept = F.filter("lines", lambda x: (_body(x) != "") & ~_body(x).rlike(r"^(//|/\*|\*)"))
    texts = _lines(spark, sf_dir).where(F.col("language").isin("c", "cpp", "java")).select("record_id", "role", kept.alias("k")).where(F.size("k") > 0)
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    begin = F.struct(F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("most"))

    def step(a: F.Column, x: F.Column) -> F.Column:
        run = a["run"] + count(x, "{") - count(x, "}")
        return F.struct(run.alias("run"), (a["sum"] + F.greatest(run, F.lit(0))).cast("bigint").alias("sum"), F.greatest(a["most"], run).alias("most"))

    out = texts.select("record_id", "role", F.size("k").alias("n"), F.aggregate("k", begin, step).alias("d"))
    return out.select("record_id", "role", F.round(F.col("d.sum") / F.col("n"), 6).alias("mean_depth"), F.col("d.most").cast("bigint").alias("max_depth"))


def line_comment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the non-blank lines that begin as a comment (without block state)."""
    bodies = _lines(spark, sf_dir).where(F.col("language").isNotNull()).select("record_id", "role", "language", F.filter(F.transform("lines", _body), lambda x: x != "").alias("b")).where(F.size("b") > 0)
    n = F.size(F.filter("b", lambda x: F.when(F.col("language") == "py", x.startswith("#")).otherwise(x.rlike(r"^(//|/\*)"))))
    return bodies.select("record_id", "role", F.round(n / F.size("b"), 6).alias("ratio"))


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.distinct_code(_task(spark, sf_dir), ["human_src", "llm_src"])


def code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style and enhanced vectors of every distinct snippet."""
    return measure.measured(_snippets(spark, sf_dir))


def record_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 measurements of both ends of each record: vectors of distinct snippets joined back."""
    t = _task(spark, sf_dir).select("record_id", "language", F.sha2("human_src", 256).alias("h"), F.sha2("llm_src", 256).alias("m"))
    v = code_vectors(spark, sf_dir).select("language", "sha", F.concat("style", "enhanced").alias("v"), "parse_ok")
    end = lambda k, c, ok: v.select("language", F.col("sha").alias(k), F.col("v").alias(c), F.col("parse_ok").alias(ok))
    return t.join(end("h", "human", "human_parse_ok"), ["language", "h"], "left").join(end("m", "llm", "llm_parse_ok"), ["language", "m"], "left").drop("h", "m")


def transform_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transform on every distinct candidate snippet, with its audit."""
    return measure.attacked(measure.distinct_code(_task(spark, sf_dir), ["llm_src"]))


def transform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed share, mean number of changes and parse regressions by language and transform."""
    return transform_audit(spark, sf_dir).groupBy("language", "attack").agg(
        F.count("*").alias("n_snippets"), F.count_if("changed").alias("n_changed"), F.round(F.avg("transform_count"), 6).alias("mean_changes"), F.count("failure_reason").alias("n_regressions")
    )


def attack_feature_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute change of the 28 measurements by language and transform, over candidate snippets that the transform changed without a parse regression."""
    audit = transform_audit(spark, sf_dir).where("changed and failure_reason is null")
    pairs = stash(audit.select("language", "attack", F.col("input_sha256").alias("before"), F.col("output_sha256").alias("after"), "code"), "attacked")
    old = _snippets(spark, sf_dir).join(pairs.select("language", F.col("before").alias("sha")).distinct(), ["language", "sha"], "left_semi")
    new = pairs.select("language", F.col("after").alias("sha"), "code").dropDuplicates(["language", "sha"])
    vectors = lambda d, k, c: measure.measured(d).select("language", F.col("sha").alias(k), F.concat("style", "enhanced").alias(c))
    both = pairs.drop("code").join(vectors(old, "before", "x"), ["language", "before"]).join(vectors(new, "after", "y"), ["language", "after"])
    shift = F.zip_with("x", "y", lambda a, b: F.abs(b - a))
    return both.groupBy("language", "attack").agg(F.count("*").alias("n_snippets"), F.array(*(F.round(F.avg(F.element_at(shift, i + 1)), 6) for i in range(28))).alias("mean_shift"))


def first_k_groups(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """Rows of the first k human sources of each language in order of appearance, whole groups (the limit is the feature)."""
    t = normalize_source_id(spark, sf_dir).join(_task(spark, sf_dir).select("record_id", "language"), "record_id").where("human_source_id is not null and language is not null")
    groups = t.groupBy("language", "human_source_id").agg(F.min("record_id").alias("first_row"), F.count("*").alias("n_rows"))
    return groups.selectExpr("*", "cast(row_number() over (partition by language order by first_row) as bigint) as place").where(F.col("place") <= k)


def comment_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the C-family candidates with the fixed comment line on top."""
    line = F.when(F.col("language") == "py", F.lit(None)).otherwise(F.lit(transforms.INJECTED["c"] + "\n"))
    t = _task(spark, sf_dir).where(F.col("language").isin("c", "cpp", "java") & F.col("llm_src").isNotNull())
    return t.select("record_id", F.sha2("llm_src", 256).alias("input_sha256"), F.sha2(F.concat(line, "llm_src"), 256).alias("output_sha256"))


def line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing blanks removed and runs of blank lines collapsed (unprotected text): digest and number of lines kept. Records with a carriage return are left out, as in the SQL; line_layout_all has them."""
    bare = F.regexp_replace("human_src", r"(?m)[ \t]+$", "")
    calm = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+", "")
    return _task(spark, sf_dir).where("human_src is not null and human_src not like '%\r%'").select("record_id", F.sha2(calm, 256).alias("output_sha256"), F.size(F.split(calm, "\n")).cast("bigint").alias("n_lines"))


def line_layout_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_layout of every record with human_src: lines end with CRLF, LF or CR as in the transforms, and kept lines keep their ends."""
    end = r"(?>\r\n|\n|\r)"
    bare = F.regexp_replace("human_src", r"[ \t]+(?=[\r\n]|\z)", "")
    calm = F.regexp_replace(F.regexp_replace(bare, f"({end}{end}){end}+", "$1"), r"\A[\r\n]+", "")
    return _task(spark, sf_dir).where("human_src is not null").select("record_id", F.sha2(calm, 256).alias("output_sha256"), F.size(F.split(calm, r"\r\n|\n|\r")).cast("bigint").alias("n_lines"))


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def pair_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation of token likeness, length ratio and line ratio by language and label."""
    t = _task(spark, sf_dir).where("human_src is not null and llm_src is not null")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(TOKENS), 0))
    lines = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(F.translate(x, "\t\r\f", "   ")) != ""))
    sets = t.select("language", "label", tokens("human_src").alias("a"), tokens("llm_src").alias("b"), F.length("human_src").alias("la"), F.length("llm_src").alias("lb"), lines("human_src").alias("na"), lines("llm_src").alias("nb"))
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    scores = sets.select("language", F.col("label").cast("bigint").alias("label"), F.when(either > 0, both / either).otherwise(1.0).alias("token_jaccard"), _ratio(F.col("la"), F.col("lb")).alias("length_ratio"), _ratio(F.col("na"), F.col("nb")).alias("line_ratio"))
    long = scores.unpivot(["language", "label"], ["token_jaccard", "length_ratio", "line_ratio"], "metric", "value")
    return long.groupBy("language", "label", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and MCC of label 1, predicted where the shorter code has at least nine tenths of the longer's length."""
    t = _task(spark, sf_dir).where("human_src is not null and llm_src is not null and label is not null")
    p = _ratio(F.length("human_src"), F.length("llm_src")) >= 0.9
    y = F.col("label") == 1
    c = t.groupBy("language").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    return binary_scores(c)


def binary_scores(c: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 (0 on a zero division) and mcc to counts tp, fp, fn, tn."""
    d = lambda x: F.col(x).cast("double")
    over = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn, tn = d("tp"), d("fp"), d("fn"), d("tn")
    return c.select(
        "*",
        over(tp, tp + fp).alias("precision"),
        over(tp, tp + fn).alias("recall"),
        over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve by language from counts per score, so that ties take their average rank without ranking rows."""
    t = _task(spark, sf_dir).where("human_src is not null and llm_src is not null and label is not null")
    scored = t.select("language", F.round(_ratio(F.length("human_src"), F.length("llm_src")), 6).alias("score"), (F.col("label") == 1).cast("bigint").alias("y"))
    per = scored.groupBy("language", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("language").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.select("language", "pos", "neg", (F.col("pos") * (below + F.col("neg") / 2.0)).alias("wins"))
    return wins.groupBy("language").agg(F.round(F.sum("wins") / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0)), 6).alias("auroc"))


QUERIES = {
    f.__name__: f
    for f in (
        strict_jsonl_scan, normalize_source_id, code_sha_inventory, naming_class_counts, naming_consistency, indentation_consistency,
        identifier_entropy, identifier_length_stats, format_features, brace_nesting_depth, line_comment_ratio, code_vectors, record_features,
        transform_audit, transform_summary, attack_feature_shift, first_k_groups, comment_injection, line_layout, line_layout_all, pair_difficulty, binary_metrics, auroc_rank,
    )
}

_STYLE_SQL = "case " + " ".join(f"when regexp_matches(name, '{p}') then '{n}'" for n, p in (("camelCase", "^[a-z]+(?:[A-Z][a-z]*)*$"), ("snake_case", "^[a-z]+(?:_[a-z]+)+$"), ("PascalCase", "^[A-Z][a-z]+(?:[A-Z][a-z]*)*$"), ("UPPER_SNAKE_CASE", "^[A-Z]+(?:_[A-Z]+)+$"))) + " else 'Other' end"
_TEXTS_SQL = "both_texts as (select record_id, language, 'human' as role, human_src as text from task1 where human_src is not null union all select record_id, language, 'llm', llm_src from task1 where llm_src is not null)"
_NAMES_SQL = _TEXTS_SQL + r", names as (select record_id, role, unnest(regexp_extract_all(text, '(?m)^[ \t]*def[ \t]+([A-Za-z0-9_]+)[ \t]*\(', 1)) as name from both_texts where language = 'py')"
_WORDS_SQL = f"{_TEXTS_SQL}, words as (select record_id, role, unnest(regexp_extract_all(text, '{_ID}')) as w from both_texts)"
_LINES_SQL = _TEXTS_SQL + r""", texts as (select record_id, language, role, string_split(regexp_replace(text, '\n$', ''), chr(10)) as ls from both_texts where text <> ''),
lines as (select record_id, language, role, unnest(ls) as line, unnest(range(len(ls))) as line_no from texts)"""
_BODY = "trim(translate(line, chr(9) || chr(13) || chr(12), '   '))"
_SCORED = "select language, label, case when length(human_src) > 0 and length(llm_src) > 0 then least(length(human_src), length(llm_src)) / greatest(length(human_src), length(llm_src)) else 0.0 end as r from task1 where human_src is not null and llm_src is not null and label is not null"
_TOK = f"list_distinct(regexp_extract_all({{0}}, '{TOKENS}'))"
_FULL = "len(list_filter(string_split({0}, chr(10)), lambda x: trim(translate(x, chr(9) || chr(13) || chr(12), '   ')) <> ''))"

ORACLE = {
    "strict_jsonl_scan": """select case when trim(coalesce(line, '')) = '' then 'blank' when not json_valid(line) then 'not json' when json_type(line) <> 'OBJECT' then 'not an object'
      when json_extract(line, '$.human_src') is null or json_type(line, '$.human_src') = 'NULL' or json_extract(line, '$.llm_src') is null or json_type(line, '$.llm_src') = 'NULL' or json_extract(line, '$.label') is null or json_type(line, '$.label') = 'NULL' then 'missing field' else 'record' end as status,
      count(*) as n_lines from task1_raw group by 1""",
    "normalize_source_id": "select record_id, case when label = 0 then human_file_name else file_name end as human_source_id from task1",
    "first_k_groups": "with g as (select language, case when label = 0 then human_file_name else file_name end as human_source_id, min(record_id) as first_row, count(*) as n_rows from task1 where language is not null group by 1, 2) select * from (select *, row_number() over (partition by language order by first_row) as place from g where human_source_id is not null) where place <= 50",
    "code_sha_inventory": "select language, count(*) as n_rows, count(*) filter (label = 1) as n_positive, count(distinct sha256(human_src)) as n_human, count(distinct sha256(llm_src)) as n_llm from task1 group by 1",
    "naming_class_counts": f"with {_NAMES_SQL} select role, {_STYLE_SQL} as style, count(*) as n_names, count(distinct name) as n_distinct from names group by 1, 2",
    "naming_consistency": f"with {_NAMES_SQL}, c as (select record_id, role, {_STYLE_SQL} as style, count(*) as n, sum(length(name)) as chars from names group by 1, 2, 3) select record_id, role, round(max(n) / sum(n), 6) as consistency, round(sum(chars) / sum(n), 6) as mean_length from c group by 1, 2",
    "indentation_consistency": rf"""with {_LINES_SQL}, b as (select record_id, role, line, regexp_replace(line, '^[ \t\r\f]+', '') as body from lines),
      w as (select record_id, role, case when body <> '' and not regexp_matches(body, '^(#|//|/\*|\*)') and length(line) > length(body) then length(replace(substr(line, 1, length(line) - length(body)), chr(9), '    ')) end as width from b),
      c as (select record_id, role, width, count(*) as n from w group by 1, 2, 3)
      select record_id, role, round(coalesce(max(n) filter (width is not null) / sum(n) filter (width is not null), 1.0), 6) as consistency from c group by 1, 2""",
    "identifier_entropy": f"with {_WORDS_SQL}, c as (select record_id, role, w, count(*) as n from words group by 1, 2, 3), t as (select *, n / sum(n) over (partition by record_id, role) as p from c) select record_id, role, round(-sum(p * log2(p)), 6) + 0.0 as entropy from t group by 1, 2",
    "identifier_length_stats": f"with {_WORDS_SQL} select record_id, role, count(*) as n_words, round(avg(length(w)), 6) as mean_length, round(stddev_pop(length(w)), 6) as sd_length from words group by 1, 2",
    "format_features": f"with {_LINES_SQL} select record_id, role, round(count(*) filter ({_BODY} = '') / count(*), 6) as blank_ratio, round(coalesce(avg(length(line)) filter ({_BODY} <> ''), 0.0), 6) as mean_length, round(coalesce(stddev_pop(length(line)) filter ({_BODY} <> ''), 0.0), 6) as sd_length from lines group by 1, 2",
    "brace_nesting_depth": rf"""with {_LINES_SQL}, k as (select record_id, role, line_no, 2 * length(line) - length(replace(line, '{{', '')) - length(line) - (length(line) - length(replace(line, '}}', ''))) as step from lines
      where language in ('c', 'cpp', 'java') and {_BODY} <> '' and not regexp_matches({_BODY}, '^(//|/\*|\*)')),
      d as (select record_id, role, greatest(sum(step) over (partition by record_id, role order by line_no), 0) as depth from k)
      select record_id, role, round(avg(depth), 6) as mean_depth, max(depth)::bigint as max_depth from d group by 1, 2""",
    "line_comment_ratio": rf"with {_LINES_SQL} select record_id, role, round(count(*) filter (case when language = 'py' then starts_with({_BODY}, '#') else regexp_matches({_BODY}, '^(//|/\*)') end) / count(*), 6) as ratio from lines where {_BODY} <> '' and language is not null group by 1, 2",
    "comment_injection": "select record_id, sha256(llm_src) as input_sha256, sha256('/* deterministic T4 style probe */' || chr(10) || llm_src) as output_sha256 from task1 where language in ('c', 'cpp', 'java') and llm_src is not null",
    "line_layout": r"""with x as (select record_id, regexp_replace(regexp_replace(regexp_replace(human_src, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', '') as t from task1 where human_src is not null and not contains(human_src, chr(13)))
      select record_id, sha256(t) as output_sha256, len(string_split(t, chr(10))) as n_lines from x""",
    "pair_difficulty": f"""with s as (select language, label::bigint as label, {_TOK.format("human_src")} as a, {_TOK.format("llm_src")} as b, length(human_src) as la, length(llm_src) as lb, {_FULL.format("human_src")} as na, {_FULL.format("llm_src")} as nb from task1 where human_src is not null and llm_src is not null),
      v as (select language, label, case when len(list_distinct(a || b)) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 1.0 end as token_jaccard,
        case when la > 0 and lb > 0 then least(la, lb) / greatest(la, lb) else 0.0 end as length_ratio, case when na > 0 and nb > 0 then least(na, nb) / greatest(na, nb) else 0.0 end as line_ratio from s),
      u as (unpivot v on token_jaccard, length_ratio, line_ratio into name metric value value)
      select language, label, metric, count(*) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0.0), 6) as sd from u group by 1, 2, 3""",
    "binary_metrics": f"""with s as ({_SCORED}), c as (select language, count(*) filter (r >= 0.9 and label = 1) as tp, count(*) filter (r >= 0.9 and label <> 1) as fp, count(*) filter (r < 0.9 and label = 1) as fn, count(*) filter (r < 0.9 and label <> 1) as tn from s group by 1)
      select *, round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1,
        round(case when sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) > 0 then (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) else 0.0 end, 6) as mcc from c""",
    "auroc_rank": f"""with s as (select language, round(r, 6) as score, label = 1 as y from ({_SCORED})), k as (select *, rank() over (partition by language order by score) + (count(*) over (partition by language, score) - 1) / 2.0 as rk from s)
      select language, round((sum(rk) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2.0) / nullif(count(*) filter (y) * (count(*) filter (not y))::double, 0), 6) as auroc from k group by 1""",
}
