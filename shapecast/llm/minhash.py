"""MinHash near-dedup: universal hash minima in bands, signatures, full sets, connected components.

Texts with the same shingle set are one node, so that copies never meet in a bucket. Every bucket of a band is compared as
a star around its smallest node, and where it still holds several components then, as one around the node with many
shingles in common with others and few of its own. In buckets that still hold several afterwards, the pairs across components are
compared that the star left out, but for those that can't be links: the shingles that a text shares with others bound the
intersection, and so the sizes that a partner may have. A pair passes size, signature and at last full-set comparison
before it is a link.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forget, small
from .tokens import tokens, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands for a null id.
NO_ID = (1 << 63) - 1
MULT, FIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive word hashes; of the whole sequence if it is shorter."""
    w = words
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * MULT
        h ^= h >> np.uint64(29)
    h = h * FIN
    return np.unique(h ^ (h >> np.uint64(32)))


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n universal hash functions on 32 bits."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (a * x[None, i : i + 1024] + b).min(axis=1), out=out)
    return out


def signer(k: int, bands: int, rows: int):
    """Arrow batches (id, th, text) to (id, th, n, digest, bands, sig)."""
    def run(batches):
        a, b = universal(bands * rows)
        for batch in batches:
            flat, at = tokens(batch.column(2))
            n, digest, keys, sig = [], [], [], []
            for i in range(batch.num_rows):
                s = shingle_set(flat[at[i] : at[i + 1]], k)
                n.append(len(s))
                if not len(s):
                    digest.append(None), keys.append(None), sig.append(None)
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = minima(s, a, b)
                h = np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(rows):
                    h = (h ^ m.reshape(bands, rows)[:, j]) * MULT
                    h ^= h >> np.uint64(31)
                keys.append(h.view(np.int64))
                sig.append((m & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["id", "th", "n", "digest", "bands", "sig"])
        trimmed()

    return run


def shingles(k: int):
    """Arrow batches (id, text) to (id, s): the shingle sets."""
    def run(batches):
        for batch in batches:
            flat, at = tokens(batch.column(1))
            sets = [shingle_set(flat[at[i] : at[i + 1]], k).view(np.int64) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return run


def alike_signatures(least: float):
    """Keeps the pairs (a, b, sig_a, sig_b) whose signatures agree in at least this part."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [np.mean(np.frombuffer(p, np.uint16) == np.frombuffer(q, np.uint16)) >= least for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def compare_sets(k: int, percent: int):
    """(a, b, text_a, text_b) to (a, b, inter, link): the full sets' intersection, and 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            inter, link, last, x = [], [], None, None
            ids = batch.column(0).to_pylist()
            (fa, oa), (fb, ob) = tokens(batch.column(2)), tokens(batch.column(3))
            for i in range(batch.num_rows):
                if ids[i] != last:
                    x, last = shingle_set(fa[oa[i] : oa[i + 1]], k), ids[i]
                both = np.concatenate((x, shingle_set(fb[ob[i] : ob[i + 1]], k)))
                both.sort()
                inter.append(int(np.count_nonzero(both[1:] == both[:-1])))
                link.append(100 * inter[-1] >= percent * (len(both) - inter[-1]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(link, pa.bool_())], ["a", "b", "inter", "link"])
        trimmed()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Words are lower-cased runs without white space; a text with fewer words than a shingle is one shingle; an empty or
    null text has none and is linked with nothing. Links: 100 * intersection >= percent * union of the full sets. With 32
    bands of 5 minima a pair at 0.8 shares no bucket with a probability of about 3e-6. Signatures only rule out pairs that
    lie five standard deviations under the limit. No bucket is cut off: a large one costs one comparison per node, and
    only pairs across components that sizes and shared shingles allow are compared besides. Documents with a null id keep
    a null component and aren't kept, though their texts link others' copies. Repeated rows share component and decision;
    rows that repeat an id with another text are judged each by its own text. A text of any length is one row of the
    comparisons, and fits in a task's memory. An empty table gives no rows. Other columns are not looked at. The ids must be
    integers under 2 ** 63 - 1.
    """
    put = Scratch()
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("own"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = put(d.mapInArrow(signer(shingle, bands, rows), "own long, th long, n long, digest binary, bands array<long>, sig binary"), "signatures")
    nodes = put(signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("own", "th", "n", "bands", "sig")).alias("x")).select("digest", "x.*"), "nodes")
    # a node's number is its id, or a hash where other nodes have the same
    twice = put(nodes.where(F.col("own") != NO_ID).groupBy("own").agg(F.count("*").alias("m")).where("m > 1"), "twice")
    nodes = nodes.join(small(twice), "own", "left").withColumn("id", F.when((F.col("own") == NO_ID) | F.col("m").isNotNull(), F.xxhash64("own", "digest")).otherwise(F.col("own"))).drop("m")
    members = nodes.select("id", F.explode("bands").alias("key"))
    centres = put(members.groupBy("key").agg(F.min("id").alias("c"), F.count("*").alias("m")).where("m > 1").select("key", "c"), "centres")
    grouped = put(members.join(small(centres), "key").select("key", "c", "id"), "buckets")
    stars = grouped.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b"))
    deviation = (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5

    def found(links: DataFrame) -> DataFrame:
        put.made.append(components(links))
        return put.made[-1]

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        near = put(near.select("a", "b", "sig_a", "sig_b").mapInArrow(alike_signatures(percent / 100 - 5 * deviation), "a long, b long"), "near")
        return compared(near).where("link").select("a", "b")

    def texts(ids: DataFrame) -> DataFrame:
        """(id, text) of these nodes."""
        need = put(nodes.join(small(ids), "id", "left_semi").select("id", "own", "th"), "need")
        return d.join(small(need), ["own", "th"]).select("id", "text").dropDuplicates(["id"])

    def compared(pairs: DataFrame) -> DataFrame:
        text = put(texts(put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")), "texts")
        full = pairs.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b")
        out = put(full.select("a", "b", "text_a", "text_b").mapInArrow(compare_sets(shingle, percent), "a long, b long, inter long, link boolean"), "links")
        forget(text)
        return out

    def spread(buckets: DataFrame, of: DataFrame) -> DataFrame:
        """The buckets that hold several components, with their nodes' components."""
        held = buckets.join(of.withColumnRenamed("node", "id"), "id", "left").select("key", "c", "id", F.coalesce("component", "id").alias("component"))
        mixed = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y").select("key")
        return put(held.join(small(put(mixed, "mixed")), "key", "left_semi"), "spread")

    links = confirmed(stars)
    of = found(links)
    # what the stars left out: pairs across components in buckets that hold several
    held = spread(grouped, of)
    if not held.isEmpty():
        ids = put(held.select("id").distinct(), "ids")
        # a shingle that no other node of these buckets has can't be in an intersection
        sets = texts(ids).mapInArrow(shingles(shingle), "id long, s array<long>")
        lone = sets.select("id", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1").groupBy("id").agg(F.count("*").alias("lone"))
        t = percent / 100
        lone = put(lone, "lone")
        able = nodes.select("id", "n").join(small(ids), "id", "left_semi").join(lone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
        able = put(able.withColumn("most", F.floor(F.col("common") / t + F.col("common") - F.col("n") + 1e-9)).where(F.col("most") >= F.floor(F.col("n") * t)), "able")
        # once more a star each, around the node with many shingles in common and few of its own: the likely source of the others
        held = put(held.join(small(able), "id"), "held")
        best = put(held.groupBy("key").agg(F.max(F.struct(F.col("common") * F.col("common") / F.col("n"), -F.col("id"))).alias("x"), F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key", (-F.col("x.col2")).alias("best")), "best")
        near = put(held.join(small(best), "key").where("id <> best").select(F.col("best").alias("a"), F.col("id").alias("b")).distinct(), "again")
        near = compared(near)
        links = links.union(near.where("link").select("a", "b"))
        of = found(links)
        # inside: shingles in common with the star's centre; outside: at most so many in common with others besides
        inside = near.select(F.col("a").alias("best"), F.col("b").alias("id"), "inter")
        held = spread(held.join(small(best), "key").where("id <> c and id <> best").select("key", "id", "c"), of).join(small(able), "id").join(small(best), "key").join(inside, ["best", "id"], "left")
        held = put(held.withColumn("inside", F.coalesce("inter", "common")).withColumn("outside", F.coalesce(F.col("common") - F.col("inter"), "common")), "held")
        # nodes that meet in many buckets meet once around their star's centre, which all of a bucket share
        held = held.select(F.col("best").alias("key"), *[c for c in held.columns if c not in ("key", "best", "c", "inter")]).distinct()
        most = held.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("component", "m").alias("largest"))
        grade = lambda n: F.floor(F.log(n) / F.log(F.lit(1.05))).cast("int")
        low, high = F.ceil(F.col("na") * t - 1e-9), F.least("most_a", F.floor(F.col("na") / t + 1e-9))
        fewer = held.join(most, "key").where("component <> largest").select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("most").alias("most_a"), F.col("inside").alias("in_a"), F.col("outside").alias("out_a"))
        fewer = fewer.where(high >= low).withColumn("grade", F.explode(F.sequence(grade(low), grade(high))))
        others = held.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("most_b"), F.col("inside").alias("in_b"), F.col("outside").alias("out_b"), grade(F.col("n")).alias("grade"))
        rest = fewer.join(others, ["key", "grade"]).where(f"ca <> cb and nb <= most_a and na <= most_b and (least(in_a, in_b) + least(out_a, out_b)) * {100 + percent} >= {percent} * (na + nb)")
        rest = put(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
        if not rest.isEmpty():
            links = links.union(confirmed(rest))
            of = found(links)
    node = nodes.select("digest", "own", "id").join(of.withColumnRenamed("node", "id"), "id", "left")
    least = put(node.where("component is not null").groupBy("component").agg(F.min("own").alias("least")), "least")
    node = put(node.join(small(least), "component", "left").select("digest", F.coalesce("least", "own").alias("component")), "classes")
    out = signed.select("own", "n", "digest").join(node, "digest", "left")
    given = lambda c: F.when(c != NO_ID, c)
    component = F.when(F.col("own") != NO_ID, given(F.coalesce("component", "own")))
    out = out.select(given(F.col("own")).alias("id"), "n", component.alias("component_id"))
    return put.result(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")), "near")
