"""Mixing sources to target weights (operator 6).

Method: each document gets a hash-random key; within its source documents are
ordered by key, in ranges of keys that hold about equally many whatever the
source; sums of sizes by range give each range its start, and a running sum
within the range gives each document its place. A source is cut at its exact
budget; a budget above the source's size goes on with further epochs over the
same order.

A null source is a source of its own and comes last; null or empty texts have
size 0 and are taken 0 times. Repeated rows count each; ties of the key are
broken by size. An empty table gives an empty result. Other columns stay as they
are; those named as one of the results give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import quoted, unused

#: Characters of words (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """Target of each source from its size (columns ``source_key``, ``source_size``): one small row a source.

    The share of all sizes is dealt by weight, the weights repeating over the
    sources in code-point order, null last. A source stops at ``most`` times its
    size; the rest is dealt among the others, which is the level at which the
    sum of min(cap, level x weight) is the share.
    """
    every = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source_key").asc_nulls_last())) - 1
    d = sizes.select("source_key", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double").alias("weight"))
    d = d.select("*", (F.col("source_size") * F.lit(float(most))).alias("cap"), (F.lit(float(share)) * F.sum("source_size").over(every)).alias("total"), F.sum("weight").over(every).alias("all_weight"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source_key").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    d = d.select("*", ((F.col("total") - before("cap")) * F.col("weight") >= F.col("cap") * (F.col("all_weight") - before("weight"))).alias("full"))
    left = lambda c, whole: F.col(whole) - F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(every)
    d = d.select("source_key", "source_size", "cap", "full", "weight", left("cap", "total").alias("rest"), left("weight", "all_weight").alias("rest_weight"))
    return d.select("source_key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest") * F.try_divide(F.col("weight"), F.col("rest_weight"))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), digits: int = 3) -> DataFrame:
    """``df`` with source_size, target and taken.

    ``digits`` hexadecimal digits of the key tell its range: 16**digits ranges a
    source, which keeps any source's rows spread over all tasks. The ranges'
    sums (at most that many rows a source) are what the running sum over ranges
    works on. ``df`` is read twice, so cut its lineage if its sizes are costly.
    """
    results = ("source_size", "target", "taken")
    d = df.select(*(quoted(c) for c in df.columns if c.lower() not in results))
    mark, name, part, own, begin, sums, plain = unused([*d.columns, *results], "mark", "name", "part", "own", "begin", "sums", "source_key")
    d = d.withColumns({mark: F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), name: F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))})
    d = d.withColumn(part, F.substring(mark, 1, digits))
    ranges = d.groupBy(name, part).agg(F.sum(size).alias(sums), F.first(source, True).alias(plain))
    sizes = ranges.groupBy(name).agg(F.sum(sums).alias("source_size"), F.max(plain).alias("source_key"))
    targets = budgets(sizes, share, most, weights).select(F.coalesce(F.concat(F.lit("s"), "source_key"), F.lit("n")).alias(name), "source_size", "target")
    before = F.sum(sums).over(W.partitionBy(name).orderBy(part)) - F.col(sums)
    placed = ranges.select(name, part, before.alias(begin)).join(targets, name)
    sum_before = F.sum(size).over(W.partitionBy(name, part).orderBy(mark, size).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn(own, F.coalesce(sum_before, F.lit(0))).join(placed, [name, part])
    place = F.col(begin) + F.col(own)
    budget = F.floor("target")
    within = lambda x: F.greatest(F.lit(0), F.least(F.col(size), x))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)  # whole epochs
    taken = epochs * F.col(size) + within(budget - epochs * F.col("source_size") - place)
    return d.withColumn("taken", taken.cast("long")).drop(mark, name, part, own, begin)


def taken_rows(df: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """A row for each time that a document is taken; the last may be cut after its share of words.

    Documents without a word have nothing to take and go.
    """
    (copy,) = unused(df.columns, "copy")
    d = df.where(F.col("taken") > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col(size)) - 1).cast("int"))))
    words = F.least(F.col(size), F.col("taken") - F.col(copy) * F.col(size))
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    return d.withColumn(text, F.when(words >= F.col(size), F.col(text)).otherwise(cut)).drop(copy)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before, sum(weight) OVER () AS all_weight FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - cap_before) * weight >= cap * (all_weight - weight_before) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
        (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * (weight / nullif(all_weight - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER (), 0)) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - place)) AS BIGINT) AS taken FROM e
"""
