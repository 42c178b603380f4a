"""Benchmark decontamination by winnowing.

Every text keeps the smallest k-gram hash of each run of `window - k + 1` k-grams (the leftmost of equals). Two texts that
share `window` words share such a run, and so the k-gram kept there: a join on kept hashes finds every shared window. Each
hit is then extended to all windows around it, which are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let, small, words_alnum


def _kept(n: Column, grams: Column, window: int, k: int) -> Column:
    """Positions (from 0) of the k-grams that winnowing keeps."""
    run = window - k + 1
    at = F.transform(F.sequence(F.lit(0), n - window), lambda i: let(F.slice(grams, i + 1, run), lambda s: (i + F.array_position(s, F.array_min(s)) - 1).cast("int")))
    return F.when(n >= window, F.array_distinct(at)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, n: Column, k: int) -> Column:
    """Hash of the k words from each position on."""
    def grams(h):
        return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    return F.when(n >= k, let(F.transform(words, lambda w: F.xxhash64(w)), grams))


def _windows(words: Column, n: Column, size: Column | int) -> Column:
    """(s, t): start and text of each window of so many words."""
    return F.transform(F.sequence(F.lit(0), n - size), lambda s: F.struct(s.alias("s"), F.array_join(F.slice(words, s + 1, size if isinstance(size, Column) else F.lit(size)), " ").alias("t")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted item ids), contaminated.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A document
    word inside an occurrence of any window is hit. Null and empty texts have no words. A null item id counts as an empty
    string. Repeated document rows each get their row; an empty benchmark leaves every document clean; an empty table gives
    no rows. A text of any length is one row, and its words fit in a task's memory. Other columns are not looked at. Hits are gathered per document, as many as it has words at most. The benchmark's windows are broadcast
    only if there are few of them; else both joins shuffle, with the words around each k-gram.
    """
    spark = docs.sparkSession
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_alnum(F.col(item_text)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    size = F.least(F.col("n"), F.lit(window))
    per_item = items.select("item", size.alias("len"), F.explode(_windows(F.col("words"), F.col("n"), size)).alias("x"))
    wins = per_item.groupBy(F.col("x.t").alias("wt"), F.col("len").alias("wl")).agg(F.array_sort(F.collect_set("item")).alias("win_items"))
    full = items.where(F.col("n") >= window).withColumn("g", _grams(F.col("words"), F.col("n"), k))
    prints = full.select(F.explode(F.transform(_kept(F.col("n"), F.col("g"), window, k), lambda p: F.get("g", p))).alias("print")).distinct()
    lens = wins.groupBy("wl").count().collect()  # at most `window` rows
    n_wins, short = sum(r["count"] for r in lens), sorted(r["wl"] for r in lens if r["wl"] < window)
    few = n_wins <= common.BROADCAST_ROWS

    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words_alnum(F.col(text_col)).alias("words"))
    d = d.withColumn("n", F.size("words"))
    g = d.withColumn("g", _grams(F.col("words"), F.col("n"), k))
    g = g.withColumn("kept", _kept(F.col("n"), F.col("g"), window, k))
    run = window - k + 1
    first = F.greatest(F.col("p") - (run - 1), F.lit(0))
    around = F.slice("words", first + 1, F.lit(2 * window - k))
    # position -1 stands for the document itself; in both joins it has a key of its own, which only one task gets
    each = g.select("id", "th", "n", "words", "g", F.explode(F.concat(F.array(F.lit(-1)), "kept")).alias("p"))
    each = each.select("id", "th", "n", "p", F.when(F.col("p") >= 0, F.get("g", F.col("p"))).otherwise(F.xxhash64("id", "th")).alias("print"), ("words" if few else around.alias("words")))
    found = each.join(small(prints.withColumn("known", F.lit(True)), n_wins), "print", "left").where("p < 0 or known")
    at = F.when(F.col("p") < 0, F.array(F.lit(-1))).otherwise(F.sequence(first, F.least(F.col("p"), F.col("n") - window)))
    shift = F.lit(0) if few else first
    found = found.select("id", "th", "n", "words", shift.alias("shift"), F.explode(at).alias("s"))
    text = F.when(F.col("s") >= 0, F.array_join(F.slice("words", F.col("s") - F.col("shift") + 1, F.lit(window)), " ")).otherwise(F.hex(F.xxhash64("id", "th")))
    found = found.select("id", "th", "n", "s", text.alias("wt"), F.lit(window).alias("wl"))
    if short:  # windows shorter than what winnowing covers are looked up at every position
        sizes = F.array(*[F.lit(x) for x in short])
        some = d.select("id", "th", "n", "words", F.explode(F.filter(sizes, lambda x: x <= F.col("n"))).alias("wl"))
        some = some.select("id", "th", "n", "wl", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("wl"))).alias("s"))
        found = found.unionByName(some.select("id", "th", "n", "s", F.array_join(F.slice("words", F.col("s") + 1, F.col("wl")), " ").alias("wt"), "wl"))
    hit = found.join(small(wins.withColumn("items_id", F.xxhash64("win_items")), n_wins), ["wt", "wl"], "left").where("s < 0 or win_items is not null")
    per_doc = hit.groupBy("id", "th", "n").agg(
        F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("s") >= 0, F.struct("s", "wl")))).alias("spans"),
        F.collect_set(F.when(F.col("s") >= 0, F.col("win_items"))).alias("lists"),
    )
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["s"] + x["wl"] - F.greatest(a["end"], x["s"]))).alias("hit"), F.greatest(a["end"], x["s"] + x["wl"]).alias("end")), lambda a: a["hit"])
    out = per_doc.select("id", "n", "copies", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
