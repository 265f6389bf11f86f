"""Mixing sources to target weights (operator 10).

Tokens are summed per source, the targets follow from the sums, and each document is emitted
floor(rate) times plus once more with probability equal to the fraction of the rate, decided by a
hash of a seed and the document. Everything is DataFrame code: one partial aggregate, a window over
one row per source, and a join whose small side is the table of sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupewright.llm.common import WORD, fresh, table

#: No source is repeated more often than this.
MOST_REPEATS = 3
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weight(place: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the source's place, counted from 0."""
    return (place % 3 + 1).cast("bigint")


def source_targets(
    sizes: DataFrame, weight: Callable[[Column], Column] = cycled_weight, most: int = MOST_REPEATS
) -> DataFrame:
    """One row per source with its size and its target.

    ``sizes`` has ``source`` and ``size``. Sources are placed by code point, null last. A target is
    the source's share by weight, at most ``most`` times its size; what is above goes to the others
    by weight. With the sources ordered by cap / weight, those at their cap come first, so the level
    that the others share is found with running sums instead of repeated passes.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    everything = Window.partitionBy()
    placed = by_source.withColumn("weight", weight(F.row_number().over(Window.orderBy(*order)) - 1)).withColumn(
        "cap", F.col("source_size") * most
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), *order).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        placed.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filling), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
        .withColumn("open", F.col("cap") * F.col("left_weight") >= F.col("weight") * F.col("left_size"))
    )
    # The first open source fixes the level of all open ones; its left_weight is the largest of theirs.
    at_level = F.struct("left_weight", "left_size")
    level = levels.withColumn("level", F.max(F.when(F.col("open"), at_level)).over(everything))
    target = (F.col("weight") * F.col("level.left_size")).cast("double") / F.col("level.left_weight")
    cap = F.col("cap").cast("double")
    reached = F.col("left_weight") > F.col("level.left_weight")
    return level.select(
        "source", "source_size", F.when(F.col("level").isNull() | reached, cap).otherwise(target).alias("target")
    )


def chance(doc_id: str, text: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text alone."""
    parts = F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))
    )
    return F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def with_copies(docs: DataFrame, seed: str = SEED, weight=cycled_weight, most: int = MOST_REPEATS) -> DataFrame:
    """Add size, source_size, target and copies to each document.

    Null texts have size 0, a null source is a source like any other, repeated rows are documents of
    their own and draw alike. A source without words has rate 0. An empty table gives an empty
    result. Columns of the input that are called like the new ones are replaced.
    """
    plain = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count())
    key, size, target, drawn = fresh(plain, "_source", "source_size", "target", "_drawn")
    targets = source_targets(plain.select("source", "size"), weight, most).toDF(key, size, target)
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(F.col(drawn) < rate - whole, 1).otherwise(0)).cast("bigint")
    # Drawn before the join, so a caller that needs no texts does not shuffle any.
    rated = plain.withColumn(drawn, chance("doc_id", "text", seed)).join(targets, F.col("source").eqNullSafe(F.col(key)))
    return rated.withColumn("copies", copies).drop(key, drawn)


def mix(docs: DataFrame, seed: str = SEED, weight=cycled_weight, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the input's columns as they were."""
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    counted = with_copies(whole, seed, weight, most).where(F.col("copies") > 0)
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark, folder):
    return with_copies(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE = r"""
with sized as (
    select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), per_source as (
    select source, sum(size)::bigint as source_size from sized group by source
), placed as (
    select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, source_size * 3 as cap from per_source
), levels as (
    select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::bigint as left_size,
           (sum(weight) over () - coalesce(sum(weight) over before, 0))::bigint as left_weight
    from placed window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), level as (
    select left_size as open_size, left_weight as open_weight from levels where cap * left_weight >= weight * left_size
    order by left_weight desc limit 1
), targets as (
    select source, source_size, case when open_weight is null or left_weight > open_weight then cap::double
           else (weight * open_size)::double / open_weight end as target
    from levels left join level on true
), rated as (
    select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
           ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint::double / 4503599627370496.0 as u
    from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
       size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) as taken
from rated
"""
