"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, of target text (labelled good) and of raw text (the whole corpus), give each
document the log ratio of its probabilities. A Gumbel top-k draws documents without replacement, in proportion to their
importance weights; how many it draws follows from a limit fitted on labelled rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, written
from .tokens import tokens, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MULT = np.uint64(0x9E3779B97F4A7C15)


def features(flat: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, document of each) of the distinct words and word pairs of texts given as flat word hashes and offsets.

    A bucket counts once per document: a word that a document repeats a thousand times is one observation. How many
    tenths of its word pairs are a word with itself is one feature more.
    """
    w = flat[at[0] : at[-1]]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    one = (w * MULT) >> np.uint64(64 - bits)
    pair = (((w[:-1] * MULT) ^ (w[1:] >> np.uint64(7)) ^ w[1:]) * MULT) >> np.uint64(64 - bits)
    same = doc[:-1] == doc[1:]
    n = np.diff(at)
    twice = np.bincount(doc[:-1][same & (w[:-1] == w[1:])], minlength=len(n)) * 10 // np.maximum(n, 1)
    pairs = np.flatnonzero(n >= 5)
    level = ((twice[pairs].astype(np.uint64) + np.uint64(1)) * MULT * MULT) >> np.uint64(64 - bits)
    ids = np.concatenate((one, pair[same], level)).astype(np.int64) | (np.concatenate((doc, doc[:-1][same], pairs)) << bits)
    ids.sort()
    ids = ids[np.concatenate(([True], ids[1:] != ids[:-1]))] if len(ids) else ids
    return ids & ((1 << bits) - 1), ids >> bits


CHUNK = 4096
#: Words whose features are in memory at once, but for a single longer text.
SLICE = 125_000


def slices(texts: pa.Array):
    """(first, last, words, offsets) of runs of texts of at most SLICE words in all."""
    flat, at = tokens(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1)
        yield first, last, flat, at[first : last + 1]
        first = last


def counter(bits: int):
    """Arrow batches (good, text) to (chunk, raw, good, bad): lists of counts of CHUNK buckets each; good is null where no label is."""
    def run(batches):
        n = np.zeros((3, 1 << bits), np.int32)  # of one partition
        for batch in batches:
            labels = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            for first, _, flat, at in slices(batch.column(1)):
                ids, doc = features(flat, at, bits)
                label = labels[first + doc]
                for row, part in zip(n, (ids, ids[label == 1], ids[label == 0]), strict=True):
                    np.add.at(row, part, 1)
        for i in range(0, 1 << bits, CHUNK * 16):
            part = [row[i : i + CHUNK * 16].astype(np.int64) for row in n]
            if part[0].any():
                at = np.arange(0, len(part[0]) + 1, CHUNK, dtype=np.int32)
                yield pa.record_batch([pa.array(np.arange(i // CHUNK, i // CHUNK + len(at) - 1), pa.int64()), *[pa.ListArray.from_arrays(at, x) for x in part]], ["chunk", "raw", "good", "bad"])
        del n
        trimmed()

    return run


def ratios(counts: DataFrame, a: float = 0.5, evidence: float = 24.0) -> DataFrame:
    """(bucket, ratio, not_good, not_bad) of the buckets of labelled rows: log ratios of target to raw probability, shrunk by their evidence.

    A ratio is multiplied by the square of g / (g + evidence). g: G statistic (likelihood ratio, chi square with one degree) of the
    labelled counts. So rare n-grams, whose ratios are chance, count little each in long texts, and nothing is cut off.
    not_good, not_bad: the same without one good or bad row of those counted.
    """
    n_raw, n_good, n_bad = (max(x or 0, 1) for x in counts.agg(F.sum("raw"), F.sum("good"), F.sum("bad")).first())

    def shrunk(raw, good, bad):
        both = good + bad
        part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
        g = F.greatest(F.lit(0.0), 2 * (part(good, both * n_good / (n_good + n_bad)) + part(bad, both * n_bad / (n_good + n_bad))))
        return (F.log((good + a) / (raw * (n_good / n_raw) + a)) * F.pow(g / (g + evidence), F.lit(2.0))).cast("float")

    less = lambda x: F.greatest(x - 1, F.lit(0))
    raw, good, bad = F.col("raw"), F.col("good"), F.col("bad")
    return counts.where(good + bad > 0).select("bucket", shrunk(raw, good, bad).alias("ratio"), shrunk(less(raw), less(good), bad).alias("not_good"), shrunk(less(raw), good, less(bad)).alias("not_bad"))


def scorer(at: np.ndarray, value: np.ndarray, bits: int):
    """Arrow batches (id, good, text) to (id, good, log_ratio, apart). at, value: buckets and their ratio, not_good, not_bad.

    log_ratio: the mean over a text's distinct n-grams, as sums would weigh a long text's chance differences. apart: a labelled row's log ratio by the ratios without that row.
    """
    def run(batches):
        ratio = np.zeros((3, 1 << bits), np.float32)
        ratio[:, at] = value
        for batch in batches:
            labels = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            score, apart = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, last, flat, edges in slices(batch.column(2)):
                ids, doc = features(flat, edges, bits)
                if len(ids):
                    n = np.maximum(np.bincount(doc, minlength=last - first), 1)
                    score[first:last] = np.bincount(doc, ratio[0, ids], last - first) / n
                    mine = labels[first + doc]
                    known = mine >= 0
                    apart[first:last] = np.bincount(doc[known], ratio[2 - mine[known], ids[known]], last - first) / n
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(apart, pa.float64())], ["id", "good", "log_ratio", "apart"])
        del ratio
        trimmed()

    return run


def kth_largest(df: DataFrame, key: str, k: int, levels: int = 6, step: int = 1024) -> float:
    """A limit that k rows, or with ties a few more, reach: histograms of ever narrower ranges, without a sort."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    left = k
    for _ in range(levels):
        width = (hi - lo) / step
        if width <= 0:
            break
        bin_ = F.least(F.floor((F.col(key) - lo) / width), F.lit(step - 1))
        inside = df.where(F.col(key).between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("x"), F.max(key).alias("y"))
        w = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)  # at most `step` rows
        edge = inside.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= left).orderBy("upto").first()
        if edge is None:
            break
        left, lo, hi = left - (edge["upto"] - edge["n"]), edge["x"], edge["y"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None, length: float = 1000.0, max_labelled: int = 1_000_000, bits: int = 20, seed: int = 1) -> DataFrame:
    """One row per document: id, log_ratio, accepted, gumbel_key, kept.

    labels: (id, quality, toxic); good is quality 1 and not toxic, a null toxic counts as 0, a null quality as no label; of
    several labels of a document the worst holds. The models are fitted on at most max_labelled labels, those with the
    smallest hashes; the raw model's counts cover every document. log_ratio is a document's mean over its distinct n-grams.
    accepted: it reaches a limit under which the most labelled rows are told apart, each scored by ratios without it;
    rejecting a good one costs twice. kept: of all documents among the `keep` with the largest gumbel_key, which is length *
    log_ratio + Gumbel noise (ties at the last place are all kept), that is drawn without replacement with the importance
    weight that a text of `length` such n-grams has; keep is by default the number of accepted documents. The noise is a hash
    of the id, so reruns agree, and rows that repeat an id have the same. A null or empty text has ratio 0. Without labels
    of both kinds everything is accepted, and kept. An empty table gives no rows. A text is counted as a whole,
    and fits in a task's memory. Repeated rows stay repeated. Other columns are not looked at. The fitted vectors
    have 2 ** bits entries whatever the input.
    """
    spark = docs.sparkSession
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0)
    lab = labels.select(F.col(id_col).alias("lab_id"), good.alias("good")).where("lab_id is not null and good is not null").groupBy("lab_id").agg(F.min("good").alias("good"))
    lab = written(lab, "labels")
    n_lab = lab.count()
    if n_lab > max_labelled:
        lab, n_lab = written(lab.orderBy(F.xxhash64("lab_id")).limit(max_labelled), "labels"), max_labelled
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with_label = d.join(small(lab, n_lab), F.col("id") == F.col("lab_id"), "left")
    counted = with_label.select("good", "text").mapInArrow(counter(bits), "chunk long, raw array<long>, good array<long>, bad array<long>").repartition("chunk")
    counted = counted.select("chunk", F.posexplode(F.arrays_zip("raw", "good", "bad")).alias("at", "x")).select((F.col("chunk") * CHUNK + F.col("at")).alias("bucket"), "x.*")
    counts = written(counted.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in ("raw", "good", "bad")]), "counts")
    found = ratios(counts).toArrow()  # 2 ** bits rows at most
    at, value = found["bucket"].to_numpy(), np.stack([found[x].to_numpy() for x in ("ratio", "not_good", "not_bad")])
    scored = written(with_label.select("id", "good", "text").mapInArrow(scorer(at, value, bits), f"id {d.schema['id'].dataType.simpleString()}, good int, log_ratio double, apart double"), "scored")
    # the limit that tells the labelled rows apart best, each scored without itself; at most max_labelled of them
    known = scored.where("good is not null").select("apart", "good").toArrow()
    x, y = known["apart"].to_numpy(), known["good"].to_numpy()
    limit = float("-inf")
    if len(y) and 0 < y.sum() < len(y):
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        gain = np.cumsum(1 - y) / (1 - y).sum() - 2 * np.cumsum(y) / y.sum()  # rejecting a good one costs twice
        gain[:-1][x[1:] == x[:-1]] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] > 0:
            limit = float(x[best] + x[best + 1]) / 2 if best + 1 < len(x) else float("inf")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    out = scored.withColumn("accepted", F.col("log_ratio") > limit).withColumn("gumbel_key", length * F.col("log_ratio") - F.log(-F.log(u)))
    n, n_accepted = out.agg(F.count("*"), F.count(F.when(F.col("accepted"), 1))).first()
    keep = n_accepted if keep is None else keep
    least = float("-inf") if keep >= n else kth_largest(out, "gumbel_key", keep) if keep > 0 else float("inf")
    return out.select(F.col("id").alias(id_col), "log_ratio", "accepted", "gumbel_key", (F.col("gumbel_key") >= least).alias("kept"))
