"""Mixing sources to target weights by hash-threshold histograms.

A document belongs to the part of a source's mix with the smallest hashes. Which hash is the limit is found without
sorting: words are summed by source and the hash's leading digits, the digit in which the budget is used up is found, and
only the documents of that one bucket are summed again by the next digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_white, forget, partitions, small, written

#: Bits of the hash, and bits that one level of the histogram looks at.
BITS, STEP = 60, 12


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), as a written table.

    Sources in code point order, null last, get the weights in turn. The sum of all targets is share times all sizes; a
    target stops at most times its source's size and the excess goes to the others by weight: again and again, those whose
    part of what is left reaches their limit are full, until none is added. No task sorts all sources: they are numbered
    within ranges, and shifted by the sizes of the ranges before.
    """
    ranges = written(sizes.repartitionByRange(partitions(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))  # a row per range
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    t = ranges.join(F.broadcast(shift), "part").withColumn("r", place)
    t = t.select("source", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("r") % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * most).alias("lim"))
    t = written(t, "weights")
    left, w_left = t.agg(F.coalesce(F.sum("source_size") * share, F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    total = left
    while True:
        full = F.col("lim") * w_left <= F.col("w") * left
        lim, w = t.agg(F.coalesce(F.sum(F.when(full, F.col("lim"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if w == 0 or (total - lim, w) == (left, w_left):
            break
        left, w_left = total - lim, w
    out = written(t.select("source", "source_size", F.when(full, F.col("lim")).otherwise(F.col("w") * left / w_left).alias("target")), "targets")
    forget(ranges), forget(t)
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted).

    Each document is taken floor(target / source_size) times, and once more if its hash lies under its source's limit; the
    document at the limit is taken if that comes nearer the target. The hash is of the id, so reruns agree; rows with the
    same id share their fate, and a null id counts as an empty one. A null text has no words, a null source is a source of
    its own, an empty table gives no rows. Other columns are not looked at.
    """
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    d = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_white(F.col(text_col)).alias("size"), digest.alias("h")), "sizes")
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sums, list(weights), share, most)
    t = t.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = written(t.withColumn("left", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    n_sources = t.count()
    # (source, left, prefix): what the bucket with this prefix may still give
    at = t.where("source_size > 0").select("source", "left", F.lit(0).cast("long").alias("prefix"))
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        inside = d.join(small(at.withColumnRenamed("source", "s"), n_sources), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        hist = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        w = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        edge = hist.withColumn("upto", F.sum("n").over(w)).where("upto > left").groupBy("source").agg(F.min_by(F.struct((F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("bucket").alias("prefix"), "n", "lo", "hi"), "bucket").alias("e"))
        at = written(edge.select("source", "e.*"), "edge")
        if at.where("lo < hi").isEmpty():
            break
        at, last = at.select("source", "left", "prefix"), at
    else:
        at = last
    limit = at.select(F.col("source").alias("s"), F.when(F.col("n") - F.col("left") < F.col("left"), F.col("lo")).otherwise(F.col("lo") - 1).alias("limit"))
    t = t.join(limit, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("source").alias("s"), "source_size", "target", "times", "left", F.coalesce("limit", F.when(F.col("left") > 0, F.lit((1 << BITS) - 1)).otherwise(-1)).alias("limit"))
    out = d.join(small(t, n_sources), F.col("s").eqNullSafe(F.col("source")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("times") + (F.col("h") <= F.col("limit")).cast("long"))).alias("taken"))
