"""Quality rules: a threshold table compiled into one projection of ratios over the whole text, without user functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in for it as was on are by this from at an or "
    "le la les de des du et un une en que qui dans pour par sur pas au avec plus ce "
    "der die das und ist nicht ein eine von zu mit den dem sich auf für als im auch "
    "el los las y es por con para una su del se lo como más o pero a he"
).split()

#: (name, ratio, lowest, highest): a document is kept if every ratio lies within its bounds (null: no bound).
RULES = [
    ("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.15),
    ("exclamation_ratio", "n_exclamations / n_words", None, 0.5),
    ("stop_word_ratio", "n_stop_words / n_words", 0.04, None),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.3),
]
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
_SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
_WORD = "[^\\\\x20\\\\x09-\\\\x0D]"


def compile_rules(rules: list = RULES) -> tuple[str, dict[str, str]]:
    """SQL of the verdict (true: all rules hold) and of each ratio; an empty denominator gives 0."""
    ratios, tests = {}, []
    for name, ratio, low, high in rules:
        top, bottom = ratio.split(" / ")
        ratios[name] = f"coalesce(cast({top} AS double) / nullif({bottom}, 0), 0.0D)"
        tests += [f"{name} >= {low}D"] * (low is not None) + [f"{name} <= {high}D"] * (high is not None)
    return " AND ".join(tests), ratios


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of every whole text, with the columns ``keep``.

    A window of eight words is named by a 64-bit hash; repeated windows are found per text by sorting these, and
    only in texts that have any. Nothing is exchanged.
    """
    stop = ", ".join(f"'{w}'" for w in [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])
    kept = list(keep)
    text = docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    parts = text.select(
        *kept, "__t",
        F.expr(f"filter(split(__t, '{_SPACE}+'), w -> w <> '')").alias("__words"),
        F.expr(f"filter(split(__t, '\\n', -1), l -> l RLIKE '{_WORD}')").alias("__lines"),
    )
    counts = parts.select(
        *kept, "__words",
        F.expr("cast(size(__words) AS long)").alias("n_words"),
        F.expr("cast(length(translate(__t, ' \\u0009\\u000A\\u000B\\u000C\\u000D', '')) AS long)").alias("word_chars"),
        F.expr("cast(length(__t) - length(translate(__t, '#*$%&|<>', '')) AS long)").alias("n_symbols"),
        F.expr("cast(length(__t) - length(translate(__t, '!', '')) AS long)").alias("n_exclamations"),
        F.expr("cast(size(__lines) AS long)").alias("n_lines"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) AS long)").alias("n_dup_lines"),
        F.expr("cast(size(filter(__lines, l -> ltrim(l) RLIKE '^[-*\\u2022]')) AS long)").alias("n_bullet_lines"),
        F.expr("cast(size(filter(__lines, l -> rtrim(l) RLIKE '(\\\\.\\\\.\\\\.|\\u2026)$')) AS long)").alias("n_ellipsis_lines"),
        F.expr(f"cast(size(filter(__words, w -> w IN ({stop}))) AS long)").alias("n_stop_words"),
    )
    rest = [c for c in counts.columns if c != "__words"]
    hashed = counts.select(*rest, F.expr(
        f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(1, cast(n_words AS int) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW}))) END"
    ).alias("__wins"))
    ordered = hashed.select(*rest, F.expr(
        "CASE WHEN size(array_distinct(__wins)) < size(__wins) THEN sort_array(transform(__wins, (h, i) -> struct(h, i))) END"
    ).alias("__order"))
    starts = ordered.select(*rest, F.expr(
        "sort_array(transform(filter(__order, (x, k) -> (k > 0 AND __order[k - 1].h = x.h) OR (k + 1 < size(__order) AND __order[k + 1].h = x.h)), x -> x.i))"
    ).alias("__starts"))
    return starts.select(*rest, F.expr(
        f"coalesce(aggregate(transform(__starts, (s, k) -> IF(k + 1 < size(__starts), least({WINDOW}, __starts[k + 1] - s), {WINDOW})), 0L, (a, b) -> a + b), 0L)"
    ).alias("n_repeat_words"))


def _base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


def judge(docs: DataFrame, *keep: str, rules: list = RULES) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of every document, with the columns ``keep``.

    Null and empty texts have no words: they fail the base and are not kept. Repeated rows are judged one by one;
    columns not named in ``keep`` are ignored, so that clashing names do no harm.
    """
    verdict, ratios = compile_rules(rules)
    table = measured(docs, *keep).withColumns({k: F.expr(v) for k, v in ratios.items()})
    table = table.withColumn("base_failed", _base_failed())
    return table.withColumn("kept", ~F.col("base_failed") & F.expr(verdict))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    The row id keeps the optimizer from copying the whole chain of counts into the filter.
    """
    own = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("__doc"), F.col("text"))
    judged = judge(packed, "__doc").select("__doc", "kept", F.monotonically_increasing_id().alias("__id"))
    return judged.filter("kept AND __id >= 0").select("__doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _duck_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])
    space = r"[\x20\x09-\x0D]+"
    verdict, ratios = compile_rules()
    named = ", ".join(f"{v.replace('0.0D', '0.0')} AS {k}" for k, v in ratios.items())
    verdict = re.sub(r"(\d)D\b", r"\1", verdict)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, rid, t, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_replace(l, '{space}', '', 'g') <> '') AS ls FROM d),
win AS (SELECT rid, i, list_aggregate(list_slice(ws, i, i + {WINDOW - 1}), 'string_agg', ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM p WHERE len(ws) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(ls, lambda l: regexp_matches(ltrim(l), '^[-*•]'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(ls, lambda l: regexp_matches(rtrim(l), '(\\.\\.\\.|…)$'))) AS BIGINT) AS n_ellipsis_lines,
  CAST(len(list_filter(ws, lambda w: w IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM p LEFT JOIN cov USING (rid)),
r AS (SELECT *, {named}, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {verdict}) AS kept FROM r"""


ORACLE_SQL = _duck_sql()
