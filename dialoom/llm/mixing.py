"""Mixing sources to target weights: each document is repeated at its source's rate.

Tokens are added up per source, every source gets a target, and the rate is target / size. A
document comes out ``floor(rate)`` times plus once more with the probability of the rate's
fraction; the draw is a hash of the seed, the id and the text's digest, so reruns agree.

Defined results: a NULL source is a source of its own, after all others. A NULL or empty text has
size 0. A source without words has target 0 and rate 0. Repeated rows (equal id and text) draw
alike. An empty table gives an empty mix. Work columns begin with ``_mix`` so that columns of the
input keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import count_words, hash_fraction, whole
from dialoom.session import materialize

#: Weights repeat over the sources in code point order, NULL last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all sizes, to be shared out
CAP = 2.0  # times a source's size, the most it may give
SEED = 5


def _source_key(column: str) -> Column:
    """A key that is never NULL and sorts by code point, NULL last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def _ranked(sources: DataFrame, key: str) -> DataFrame:
    """``_mix_rank``, from 0, in the order of ``key``.

    Sources may be as many as hosts, so they are range-partitioned and numbered per slice; a
    table with one row per slice gives the offsets.
    """
    rows = materialize(
        sources.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_mix_id", F.monotonically_increasing_id())
    )
    part, at = F.shiftrightunsigned("_mix_id", 33), F.col("_mix_id").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_mix_part", part).withColumn("_mix_at", at)
    sizes = rows.groupBy("_mix_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_mix_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_mix_before"))
    joined = rows.join(F.broadcast(offsets), "_mix_part")  # one row per shuffle partition
    return joined.withColumn("_mix_rank", F.col("_mix_before") + F.col("_mix_at")).drop(
        "_mix_id", "_mix_part", "_mix_at", "_mix_before"
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``_mix_key, source_size, target`` from ``_mix_key, source_size``, one row per source.

    Each source's target is ``weight * level``, at most ``cap`` times its size. The level is
    raised until all of the share is given out or every source is full: sources at their cap
    leave, the others share what remains by weight, until none is above. Each pass is one sum
    over the table of sources and fills at least one more source.
    """
    spark = sizes.sparkSession
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _ranked(sizes, "_mix_key").withColumn(
        "_mix_weight", F.get(cycle, (F.col("_mix_rank") % len(weights)).cast("int"))
    )
    ranked = materialize(ranked.withColumn("_mix_cap", F.col("source_size") * F.lit(float(cap))))
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    budget, level = share * total, 0.0
    while total:
        full = F.col("_mix_weight") * F.lit(level) >= F.col("_mix_cap")
        row = ranked.agg(
            F.sum(F.when(full, F.col("_mix_cap")).otherwise(0.0)).alias("given"),
            F.sum(F.when(~full, F.col("_mix_weight")).otherwise(0.0)).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        raised = (budget - row["given"]) / row["weight"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_mix_weight") * F.lit(level), F.col("_mix_cap"))
    return ranked.select("_mix_key", "source_size", target.cast("double").alias("target"))


def rates(sized: DataFrame, size: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``_mix_key, source_size, target, _mix_rate`` from rows with ``_mix_key`` and a size each."""
    sizes = sized.groupBy("_mix_key").agg(F.sum(size).alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return targets(sizes, weights, share, cap).withColumn("_mix_rate", rate)


def draw_copies(rows: DataFrame, plan: DataFrame, id_column: str, digest: Column, source_column: str, seed: int) -> DataFrame:
    """The rows with ``_mix_copies``: the whole part of the rate, and one more by the draw.

    The join lets a large source be split; the table of sources is broadcast only if it is
    measured as small.
    """
    rate = F.col("_mix_rate")
    extra = F.col("_mix_draw") < rate - F.floor(rate)
    keyed = rows.withColumn("_mix_key", _source_key(source_column)).withColumn(
        "_mix_draw", hash_fraction(F.col(id_column), digest, seed=seed)
    )
    joined = keyed.join(plan, "_mix_key")
    return joined.withColumn("_mix_copies", (F.floor(rate) + F.when(extra, 1).otherwise(0)).cast("int"))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
) -> DataFrame:
    """The documents of the mix, each as often as its copies say, with the input's columns."""
    sized = docs.select(_source_key(source_column).alias("_mix_key"), count_words(text_column).alias("_mix_size"))
    plan = rates(sized, "_mix_size", weights, share, cap).select("_mix_key", "_mix_rate")
    drawn = draw_copies(docs, plan, id_column, F.md5(whole(text_column)), source_column, seed)
    repeated = drawn.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of the registered query: the mix without its texts."""
    narrow = materialize(
        docs.select("doc_id", "source", count_words("text").alias("size"), F.md5(whole("text")).alias("_mix_text"))
    )
    plan = rates(narrow.withColumn("_mix_key", _source_key("source")), "size")
    drawn = draw_copies(narrow, plan, "doc_id", F.col("_mix_text"), "source", SEED)
    taken = (F.col("size") * F.col("_mix_copies")).cast("long").alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken)


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, list_extract([{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}],
      1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)}) AS weight,
    {CAP}::DOUBLE * source_size AS most
  FROM sources),
levels AS (
  SELECT a.most / a.weight AS full_at, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM sources)
    - sum(CASE WHEN b.most / b.weight < a.most / a.weight THEN b.most ELSE 0 END))
      / sum(CASE WHEN b.most / b.weight < a.most / a.weight THEN 0 ELSE b.weight END) AS level
  FROM weighed a, weighed b GROUP BY a.source, a.most, a.weight),
chosen AS (SELECT arg_min(level, full_at) FILTER (WHERE level <= full_at) AS level FROM levels),
planned AS (
  SELECT source, source_size, least(weight * level, most) AS target,
    CASE WHEN source_size > 0 THEN least(weight * level, most) / source_size ELSE 0.0 END AS rate
  FROM weighed, chosen)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}' || chr(31) || coalesce(doc_id::VARCHAR, chr(30)) || chr(31) || digest), 1, 13))::BIGINT
    / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source
"""
