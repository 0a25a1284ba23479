"""Quality rules per document, and per host with shrunk failure rates.

Per document: word, symbol, line and repetition counts decide the base rules. Per host (the
``source`` column): the share of its documents that fail a rule, shrunk towards the share of all
hosts with a beta prior fitted to the hosts by moments. A host whose shrunk rate is above
``HOST_LIMIT`` takes all its documents with it; the verdict is joined back to the documents.

Defined results: a NULL or empty text has no words and fails. A NULL host is a host of its own.
With fewer than two hosts, or hosts that all fail alike, the prior is uniform. Repeated rows are
counted and judged each. An empty table gives an empty result. Only the id, text and host columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import whole, words
from dialoom.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30  # per cent of the words
MAX_SYMBOLS = 10  # symbols for a hundred words that count as a failure of the host's document
MAX_DUP_LINES = 30  # per cent of the words' lines, likewise
HOST_LIMIT = 0.5


def _bound(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shared_at(hashes: Column) -> Column:
    """The positions, in order, whose hash occurs at least twice."""

    def picked(placed: Column) -> Column:
        same = lambda x, k: (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"])
        return F.array_sort(F.array_compact(F.transform(placed, lambda x, k: F.when(same(x, k), x["i"]))))

    return _bound(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), picked)


def repeated_words(word_array: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more.

    Windows are compared by 64-bit hash. Texts whose windows all differ, nearly all of them, end
    after one distinct count; the others sort their hashes.
    """
    count = F.size(word_array) - window + 1

    def with_repeats(hashes: Column) -> Column:
        def covered(starts: Column) -> Column:
            return F.aggregate(
                F.transform(starts, lambda s, k: F.least(F.lit(window), F.get(starts, k + 1) - s)),
                F.lit(0).cast("long"),
                lambda acc, n: acc + n,
            )

        return F.when(
            F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")
        ).otherwise(_bound(_shared_at(hashes), covered))

    hashes = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(word_array, i, window)))
    return F.when(count < 2, F.lit(0).cast("long")).otherwise(_bound(hashes, with_repeats))


def measures(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """One row per document with its counts; no Python, no exchange."""
    text = whole(text_column)
    chars = F.char_length(text)
    staged = docs.select(F.col(id_column), F.col(host_column).alias("_host"), text.alias("_t"), words(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return staged.select(
        id_column,
        "_host",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
    ).withColumn("_n_lines", F.size("_lines")).withColumn(
        "n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    ).drop("_lines")


def host_rates(judged: DataFrame, host: str = "_host", failed: str = "_failed") -> DataFrame:
    """``_host_key, rows, failures, shrunk``: failures per host and their shrunk rate.

    The prior's mean and strength come from the hosts' rates: with mean m and variance v of the
    rates, a + b = m (1 - m) / v - 1, at least 2 (the uniform prior's).
    """
    key = F.when(F.col(host).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(host)))
    hosts = materialize(
        judged.groupBy(key.alias("_host_key")).agg(
            F.count("*").alias("rows"), F.sum(F.col(failed).cast("long")).alias("failures")
        )
    )
    rate = F.col("failures") / F.col("rows")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    mean, spread = moments["m"], moments["v"]
    if mean is None or not 0 < mean < 1 or not spread or spread != spread:
        a = b = 1.0
    else:
        strength = max(mean * (1 - mean) / spread - 1, 2.0)
        a, b = mean * strength, (1 - mean) * strength
    return hosts.withColumn("shrunk", (F.col("failures") + F.lit(a)) / (F.col("rows") + F.lit(a + b)))


def judge_quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document."""
    counted = measures(docs, id_column, text_column, host_column)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    failed = (
        base
        | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("_n_lines"))
    )
    judged = materialize(counted.withColumn("base_failed", base).withColumn("_failed", failed))
    hosts = host_rates(judged).filter(F.col("shrunk") > F.lit(host_limit)).select(F.col("_host_key").alias("_bad"))
    key = F.when(F.col("_host").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("_host")))
    joined = judged.join(hosts, key == F.col("_bad"), "left")
    return joined.select(
        id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"),
    )


SQL = rf"""
WITH cut AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}),
    lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS gram
  FROM cut WHERE len(w) >= {WINDOW}),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
reps AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN reps USING (doc_id)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words OR 100 * n_symbols > {MAX_SYMBOLS} * n_words
      OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS failed
  FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM judged GROUP BY source),
moments AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
prior AS (
  SELECT CASE WHEN m > 0 AND m < 1 AND v > 0 THEN m * greatest(m * (1 - m) / v - 1, 2.0) ELSE 1.0 END AS a,
    CASE WHEN m > 0 AND m < 1 AND v > 0 THEN (1 - m) * greatest(m * (1 - m) / v - 1, 2.0) ELSE 1.0 END AS b
  FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (f + a) / (n + a + b) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM judged.source) AS kept
FROM judged
"""
