"""Quality rules: a threshold table compiled into one Spark projection.

Every ratio is a built-in expression over the text, so the plan is one scan
and one projection: no shuffle, no Python. A text's words are the runs
without ASCII white space.

Defined cases: a null text has no words and counts as empty; an empty text has
all counts 0 and every ratio 0; rows repeat in the result as they repeat in
the input; other columns of the input pass through ``quality_features``
untouched, unless they bear the name of a feature, in which case the feature
replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, table

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "or", "this", "from", "at", "which", "an",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "er",
    "le", "la", "les", "et", "des", "un", "une", "du", "est", "que", "dans", "qui", "par", "pour", "au", "sur", "ne", "se", "pas", "plus", "ce", "sont", "de", "en",
    "el", "los", "las", "y", "que", "del", "por", "con", "para", "una", "su", "al", "lo", "como", "más", "pero", "sus", "no", "se",
)


@dataclass(frozen=True)
class Rule:
    """A text is rejected where numerator / denominator leaves [low, high]."""

    name: str
    numerator: str
    denominator: str
    low: float = 0.0
    high: float = float("inf")


#: The threshold table in use.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", high=0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.04),
    Rule("dup_line_share", "n_dup_lines", "n_lines", high=0.5),
    Rule("repeat_word_share", "n_repeat_words", "n_words", high=0.4),
)
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 50, 3, 50


def _repeat_words() -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash and sorted with their place, so the
    cost is n log n also where a text repeats one window throughout.
    """
    windows = F.expr(
        "transform(if(size(w) < 3, cast(array() as array<string>), slice(w, 1, size(w) - 2)),"
        " (x, i) -> named_struct('h', xxhash64(x, get(w, i + 1), get(w, i + 2)), 'i', i))"
    )
    return F.sort_array(windows)


def _counted(docs: DataFrame) -> DataFrame:
    """row, a struct of the caller's columns whatever their names, and the counts."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    texts = docs.select(whole, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = texts.withColumns({
        "w": F.array_remove(F.split("t", WS), ""),
        "l": F.expr(r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"),
    })
    windows = words.withColumn("s", _repeat_words())
    places = windows.withColumn(
        "p",
        F.expr("sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k + 1).h or x.h <=> get(s, k - 1).h), x -> x.i))"),
    )
    return places.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("t", r"[^!]+", "")).cast("long").alias("n_shouts"),
        F.expr(f"size(filter(w, x -> lower(x) in ({stops})))").cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"aggregate(transform(p, (x, k) -> least({REPEAT_WORDS}, coalesce(get(p, k + 1) - x, {REPEAT_WORDS}))), 0L, (a, x) -> a + x)"
        ).alias("n_repeat_words"),
    )


def _opened(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The caller's columns, then the new ones, which replace those of their name."""
    new = [c for c in judged.columns if c != "row"]
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new)


def quality_features(docs: DataFrame) -> DataFrame:
    """``docs`` plus the counts that ``RULES`` and the base rule use."""
    return _opened(docs, _counted(docs))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean: true where no rule objects."""
    verdict = F.lit(True)
    for r in rules:
        n, d = F.col(r.numerator), F.col(r.denominator)
        if r.low > 0:
            verdict &= n >= F.lit(r.low) * d
        if r.high < float("inf"):
            verdict &= n <= F.lit(r.high) * d
    return verdict


def _judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return _counted(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``quality_features`` plus ``base_failed`` and ``kept``."""
    return _opened(docs, _judged(docs, rules))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    A generator drops the others: a filter would be pushed below the projection
    and take a copy of every count with it.
    """
    return _judged(docs).select(F.inline(F.when(F.col("kept"), F.array("row")).otherwise(F.array())))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouts", "n_lines", "base_failed", "kept"
    )


def sql(source: str = "documents") -> str:
    """The same in DuckDB's SQL: one row per document with counts, base_failed and kept."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = " AND ".join(
        f"({r.numerator} >= {r.low}::DOUBLE * {r.denominator})" if side == "low" else f"({r.numerator} <= {r.high}::DOUBLE * {r.denominator})"
        for r in RULES
        for side in ("low", "high")
        if (r.low > 0 if side == "low" else r.high < float("inf"))
    )
    return rf"""
WITH __d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
__a AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM __d),
__g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM __a)),
__r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM __g) WHERE c > 1),
__c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM __r) GROUP BY doc_id),
__f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w || [''], 'string_agg', ''))::BIGINT AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
          len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
          length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_shouts, len(l)::BIGINT AS n_lines
        FROM __a LEFT JOIN __c USING (doc_id)),
__b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM __f)
SELECT *, NOT base_failed AND ({rules}) AS kept FROM __b"""
