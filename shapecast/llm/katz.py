"""Language-model scoring with a Katz backoff n-gram model learnt from the corpus.

Texts are packed into blocks of bounded size. For each order, from single words up, a block asks for the counts of its
distinct n-grams in one packed request per bucket of the hash space; buckets add up what all blocks ask, keep the model's
tables, and answer in the order asked. So what is shuffled are distinct n-grams of blocks, not tokens, and no model table is
ever sent whole. A context asks the bucket of its first word; where that, or a longer part of it, has more than a
two-thousandth of all tokens (so fewer than 2000 have), the next word is part of the hash too.

An n-gram of a training text has a count, so only held-out texts back off: buckets return what a context's backoff weight
needs only where one of them asks.
"""

from __future__ import annotations

import struct
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, batches_of, forget, partitions, released, shared_dir
from .tokens import tokens as text_tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
#: Counts over GT are not discounted.
GT = 5
#: A context with more than one part in HEAVY of all tokens is dealt by its next word too.
HEAVY = 2000
#: Words whose counts all tasks know: those with the smallest numbers, which are the most frequent but for few.
TOP = 1 << 16
#: Of an entry in a request: its backoff weight is needed; it is dealt by its next word too.
WEIGHT, SPREAD = 1, 2


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = (h ^ x.astype(np.uint64)) * M1
        h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discount factors of the counts 0 to GT from n[r], the number of types with count r (1 to GT + 1).

    Katz: (r*/r - x) / (1 - x), r* = (r + 1) n[r + 1] / n[r], x = (GT + 1) n[GT + 1] / n[1]. Where these are undefined or
    not between 0 and 1, as in small corpora, (r - 0.5) / r for all.
    """
    r = np.arange(1, GT + 1)
    n = np.asarray(n, float)
    if (n[1 : GT + 2] > 0).all():
        x = (GT + 1) * n[GT + 1] / n[1]
        if x < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - x) / (1 - x)
            if ((d > 0) & (d < 1)).all():
                return np.concatenate(([0.0], d))
    return np.concatenate(([0.0], (r - 0.5) / r))


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count > GT, 1.0, d[np.minimum(count, GT)]) * count


class Unigrams:
    """Discounted word probabilities; what the discounts free is the probability of the one unknown word."""

    def __init__(self, n: np.ndarray, tokens: int):
        self.d, self.tokens = good_turing(n), max(tokens, 1)
        freed = sum((1 - self.d[r]) * r * n[r] for r in range(1, GT + 1))
        self.total = self.tokens + (0.5 if freed <= 0 else 0.0)
        self.unknown = (freed if freed > 0 else 0.5) / self.total if tokens else 1.0

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / self.total, self.unknown)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed planes of their bytes."""
    head, planes = [struct.pack("<B", len(arrays))], []
    for x in arrays:
        x = np.ascontiguousarray(x).view(np.uint64) if x.dtype == np.float64 else x.astype(np.uint64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head.append(struct.pack("<QB", len(x), width))
        for k in range(width):
            planes.append((x >> np.uint64(8 * k)).astype(np.uint8).tobytes())
    return b"".join(head) + pa.Codec("zstd").compress(b"".join(planes), asbytes=True)


def unpack(x: bytes) -> list[np.ndarray]:
    """The arrays, as signed numbers."""
    shapes = [struct.unpack_from("<QB", x, 1 + 9 * i) for i in range(x[0])]
    data = pa.Codec("zstd").decompress(x[1 + 9 * len(shapes) :], sum(n * w for n, w in shapes), asbytes=True)
    out, at = [], 0
    for n, width in shapes:
        y = np.zeros(n, np.uint64)
        for k in range(width):
            y |= np.frombuffer(data, np.uint8, n, at).astype(np.uint64) << np.uint64(8 * k)
            at += n
        out.append(y.view(np.int64))
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Numbers that mostly rise a little, as small ones."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return (d << 1) ^ (d >> 63)


def unsteps(y: np.ndarray) -> np.ndarray:
    return np.cumsum((y >> 1) ^ -(y & 1))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key in them)."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place.astype(np.int32)


def one_of(place: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """A value of each distinct key, all of a key being equal."""
    out = np.empty(n, values.dtype)
    out[place] = values
    return out


def blocker(size: int, id_type: pa.DataType):
    """Arrow batches (id, train, text) to blocks of about `size` tokens, but for a single longer text.

    words: the distinct words' hashes, sorted; tokens: places in it; counts: of training tokens.
    """
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, train, sizes, flat, n = [], [], [], [], 0

        def block():
            word, place = distinct(np.concatenate(flat))
            counts = np.bincount(place, np.repeat(np.array(train, float), sizes), len(word)).astype(np.int64)
            return pa.record_batch([
                pa.array([(part << 24) + made], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([train], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([pack(place)], pa.binary()), pa.array([word.tobytes()], pa.binary()), pa.array([pack(counts)], pa.binary()),
                pa.array([len(word)], pa.int64()), pa.array([n], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([sum(train)], pa.int64()),
            ], ["block", "ids", "train", "sizes", "tokens", "words", "counts", "n_words", "n_tokens", "train_tokens", "train_docs"])

        for batch in batches:
            values, at = text_tokens(batch.column(2))
            for i, (key, is_train) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(key), train.append(is_train), sizes.append(int(at[i + 1] - at[i]) + 1)
                flat.append(values[at[i] : at[i + 1]].copy()), flat.append(np.array([END]))
                n += sizes[-1]
                if n >= size:
                    yield block()
                    made += 1
                    ids, train, sizes, flat, n = [], [], [], [], 0
        if ids:
            yield block()

    return run


PARTS = "bucket long, block long, parts array<binary>"


def sent(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], ["bucket", "block", "parts"])


def word_edges(words: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.array([], np.uint64)
    return np.concatenate(([0], np.searchsorted(words, edges), [len(words)]))


def word_requests(bits: int):
    """(block, words, counts) to a bucket's requests: words, counts."""
    def run(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = np.frombuffer(words, np.uint64), unpack(counts)[0]
                at = word_edges(words, bits)
                yield sent([(b, block, [words[at[b] : at[b + 1]].tobytes(), pack(counts[at[b] : at[b + 1]])]) for b in np.flatnonzero(np.diff(at)).tolist()])

    return run


def word_answers(bits: int):
    """A bucket's requests to answers (totals, numbers), and to a row of the bucket's own (block -1): statistics, totals of the words among TOP, and its model: words, totals.

    A word's number is its rank in the bucket times the number of buckets, plus the bucket and 1: the frequent ones have
    small numbers.
    """
    def run(table):
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        words = [np.frombuffer(x["parts"][0], np.uint64) for x in rows]
        word, place = distinct(np.concatenate(words))
        total = np.bincount(place, np.concatenate([unpack(x["parts"][1])[0] for x in rows]), len(word)).astype(np.int64)
        order = np.lexsort((word, -total))
        number = np.empty(len(word), np.int64)
        number[order] = (np.arange(len(word)) << bits) + bucket + 1
        stats = np.concatenate(([np.count_nonzero(total)], np.bincount(np.minimum(total[total > 0], GT + 2), minlength=GT + 3)[1 : GT + 2]))
        ends = np.cumsum([len(w) for w in words])[:-1]
        out = [(bucket, x["block"], [pack(t, k)]) for x, t, k in zip(rows, np.split(total[place], ends), np.split(number[place], ends), strict=True)]
        top = order[: max(1, TOP >> bits)]
        seen = order[total[order] > 0]
        out.append((bucket, -1, [pack(stats, number[top], total[top]), word[seen].tobytes(), pack(total[seen])]))
        return pa.Table.from_batches([sent(out)])

    return run


def joint(answers: list, n: int) -> list[np.ndarray]:
    """The n arrays of the answers of all buckets, each in one."""
    got = [unpack(x["parts"][0]) for x in answers]
    return [np.concatenate([g[i] for g in got]) if got else np.array([], np.int64) for i in range(n)]


def renumbered(schema: pa.Schema):
    """Blocks with answers1 to blocks whose tokens are places in their words' numbers, sorted, with the words' totals."""
    def run(batches):
        for batch in batches:
            made: dict = {n: [] for n in ("tokens", "numbers", "totals")}
            for tokens, got in zip(batch.column("tokens").to_pylist(), batch.column("answers1").to_pylist(), strict=True):
                total, number = joint(sorted(got, key=lambda x: x["bucket"]), 2)
                turn = np.argsort(number)
                rank = np.empty(len(turn), np.int64)
                rank[turn] = np.arange(len(turn))
                made["tokens"].append(pack(rank[unpack(tokens)[0]])), made["numbers"].append(pack(steps(number[turn]))), made["totals"].append(pack(total[turn]))
            yield pa.record_batch([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


class Level:
    """A block's distinct n-grams of one order: context and word of each, what is asked of them and in which order."""

    def __init__(self, order: int, context: np.ndarray, at: np.ndarray, word: np.ndarray, n_words: int, lower: np.ndarray, trained: np.ndarray, below):
        """context, word, lower: of the tokens at the places `at`, that have so many words before them: the nodes of their
        context and of the n-gram without its first word; below: the level before."""
        keys, self.place = distinct(context.astype(np.int64) * n_words + word)
        self.order, self.at, self.below = order, at, below
        self.context, self.word = (x.astype(np.int32) for x in np.divmod(keys, n_words))
        self.lower = one_of(self.place, len(keys), lower)
        self.count = np.bincount(self.place, trained, len(keys)).astype(np.int64)
        self.weight = np.zeros(below.nodes, bool)  # contexts whose backoff weight a held-out text may need
        self.weight[context[~trained]] = True
        self.words, self.nodes = below.words, len(keys)
        asked = (below.total_as_context[self.context] > 0) & (below.total[self.lower] > 0)
        heavy = below.heavy
        alone = self.weight & (below.total_as_context > 0) & ~heavy
        alone[self.context[asked]] = False
        asked, alone = np.flatnonzero(asked), np.flatnonzero(alone)
        by, by_alone = self.dealt(asked), self._dealt(alone, None)
        turn = np.argsort(by, kind="stable")
        self.asked, by = asked[turn], by[turn]
        c = self.context[self.asked]
        edge = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (by[1:] != by[:-1])))) if len(c) else np.array([], np.int64)
        entry_by, entry, runs = np.concatenate((by[edge], by_alone)), np.concatenate((c[edge], alone)), np.concatenate((np.diff(np.append(edge, len(c))), np.zeros(len(alone), np.int64)))
        turn = np.argsort(entry_by, kind="stable")
        self.entry_by, self.entry, self.runs = entry_by[turn], entry[turn], runs[turn]
        self.flags = self.weight[self.entry] * WEIGHT + heavy[self.entry] * SPREAD
        # a spread context's weight comes with the sums of all its parts
        self.flags[heavy[self.entry]] = SPREAD

    def dealt(self, nodes: np.ndarray) -> np.ndarray:
        return self._dealt(self.context[nodes], self.words[self.word[nodes]])

    def _dealt(self, context: np.ndarray, word: np.ndarray | None) -> np.ndarray:
        """Hash that says which bucket: of the context's first word, and of those after as long as what is before them is heavy."""
        parts, below = self.below.names(context), self.below.chain(context)
        h = mixed(parts[0])
        for j, heavy in enumerate(below):
            if heavy.any():
                more = [*parts[: j + 1], parts[j + 1] if j + 1 < len(parts) else word if word is not None else parts[j]]
                h = np.where(heavy, mixed(*more), h)
        return (h >> np.uint64(64 - self.below.bits)).astype(np.uint16 if self.below.bits <= 16 else np.int64) if self.below.bits else np.zeros(len(h), np.uint16)

    def names(self, nodes: np.ndarray) -> list[np.ndarray]:
        """The numbers of the nodes' words."""
        return [*self.below.names(self.context[nodes]), self.words[self.word[nodes]]]

    def chain(self, nodes: np.ndarray) -> list[np.ndarray]:
        """Whether the first word, the first two, ... of these nodes are heavy."""
        return [*self.below.chain(self.context[nodes]), self.heavy[nodes]]

    def answered(self, total: np.ndarray, threshold: float, bits: int) -> None:
        """Takes the counts of what was asked, in order."""
        self.total = np.zeros(self.nodes, np.int64)
        self.total[self.asked] = total
        self.total_as_context, self.heavy, self.bits = self.total, self.total > threshold, bits


class Words:
    """A block's words as the lowest level: contexts of order 2, with the text's start as the last one."""

    def __init__(self, numbers: np.ndarray, total: np.ndarray, train_docs: int, threshold: float, bits: int):
        self.total, self.nodes, self.bits = total, len(numbers) + 1, bits
        self.total_as_context = np.append(total, train_docs)
        self.words = numbers
        self.all_names = np.append(numbers, 0)
        self.heavy = self.total_as_context > threshold

    def names(self, nodes: np.ndarray) -> list[np.ndarray]:
        return [self.all_names[nodes]]

    def chain(self, nodes: np.ndarray) -> list[np.ndarray]:
        return [self.heavy[nodes]]


class Block:
    """A block's texts, and its levels as far as they are answered."""

    def __init__(self, row: dict, model: dict, ask: bool = True):
        self.sizes, self.train = np.array(row["sizes"], np.int64), np.array(row["train"], bool)
        #: Of order 2 and up.
        self.answers = [sorted(row[f"answers{k}"] or [], key=lambda x: x["bucket"]) for k in range(2, len(model["bits"])) if f"answers{k}" in row]
        number, self.tok = unsteps(unpack(row["numbers"])[0]), unpack(row["tokens"])[0].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.place = (np.arange(len(self.tok)) - np.repeat(self.first, self.sizes)).astype(np.int32)
        self.trained = np.repeat(self.train, self.sizes)
        self.levels = [Words(number, unpack(row["totals"])[0], model["train_docs"], model["threshold"], model["bits"][1])]
        self.node = [self.tok]
        for k in range(2, len(self.answers) + 2 + ask):
            level = self.level(k)
            if k < len(self.answers) + 2:
                self.answers[k - 2] = joint(self.answers[k - 2], GT + 4)
                level.answered(self.answers[k - 2][0], model["threshold"], model["bits"][k])
                node = np.full(len(self.tok), -1, np.int32)
                node[level.at] = level.place
                self.node.append(node)
            self.levels.append(level)

    def level(self, k: int) -> Level:
        at = np.flatnonzero(self.place >= k - 2)
        below = self.levels[-1]
        if k == 2:
            context = np.empty_like(self.tok)
            context[1:] = self.tok[:-1]
            context[self.first] = below.nodes - 1
        else:
            context = self.node[-1][at - 1]
        return Level(k, context, at, self.tok[at], len(self.levels[0].words), self.node[-1][at], self.trained[at], below)


def rows_of(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield {name: c[i].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}


def requests(model: dict):
    """Blocks with the answers up to one order to requests of the next: context numbers, runs, flags, words, counts, counts of the n-grams without their first words."""
    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                level = Block(row, model).levels[-1]
                buckets, first = np.unique(level.entry_by, return_index=True)
                edges, ends = np.append(first, len(level.entry)), np.concatenate(([0], np.cumsum(level.runs)))
                word, count, lower = level.words[level.word[level.asked]], level.count[level.asked], level.below.total[level.lower[level.asked]]
                if level.order == 2:
                    lower = np.where(word <= TOP, 0, lower)
                names, out = level.below.names(level.entry), []
                for b, i, j in zip(buckets.tolist(), edges[:-1], edges[1:], strict=True):
                    u, v = ends[i], ends[j]
                    out.append((b, row["block"], [pack(*(steps(x[i:j]) for x in names), level.runs[i:j], level.flags[i:j], steps(word[u:v]), count[u:v], lower[u:v])]))
                if out:
                    yield sent(out)

    return run


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, in order."""
    if len(a) and max(int(a.max()), int(b.max())) >> 32:
        a, b = (distinct(x)[1] for x in (a, b))
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def answers(order: int, mass):
    """A bucket's requests to answers, and to a row of the bucket's own (block -1).

    An answer: counts; whether each entry has a count up to GT; and of the entries whose weight is needed the numbers of
    n-grams with the counts 1 to GT, the sum of the counts over GT, and the sum of mass(word, count without the first word).
    Own: numbers of n-grams by count; the same sums of spread contexts; the model: contexts, runs, words, counts.
    """
    def run(table):
        rows = table.to_pylist()
        parts = [list(x) for x in zip(*(unpack(x["parts"][0]) for x in rows), strict=True)]
        names = [[unsteps(x) for x in p] for p in parts[: order - 1]]
        runs, flags = parts[order - 1 : order + 1]
        words = [unsteps(x) for x in parts[order + 1]]
        counts, lower = (np.concatenate(p) for p in parts[order + 2 : order + 4])
        n_words, n_entries = [len(w) for w in words], [len(r) for r in runs]
        names, words = [np.concatenate(x) for x in names], np.concatenate(words)
        key = names[0].astype(np.uint64)
        for j, x in enumerate(names[1:]):
            key = joined(distinct(key)[1] if j else key, x)
        found, entry = distinct(key)
        n, names = len(found), [one_of(entry, len(found), x) for x in names]
        of = np.repeat(entry, np.concatenate(runs))
        found, place = distinct(joined(of, words))
        size = len(found)
        total = np.bincount(place, counts, size).astype(np.int64)
        context, word, low = (one_of(place, size, x) for x in (of, words, lower))
        del key, found, of, words, lower, counts, parts
        kept = np.flatnonzero(total > 0)
        c, t = context[kept], total[kept]
        few = np.stack([np.bincount(c, t == r, n) for r in range(1, GT + 1)]).astype(np.int64)
        many = np.bincount(c, np.where(t > GT, t, 0), n).astype(np.int64)
        sums = np.bincount(c, mass(word[kept], low[kept]), n)
        some = few.any(axis=0)
        out = []
        of_entry, of_word = np.split(entry, np.cumsum(n_entries)[:-1]), np.split(place, np.cumsum(n_words)[:-1])
        for x, e, f, w in zip(rows, of_entry, flags, of_word, strict=True):
            e1 = e[(f & WEIGHT) > 0]
            out.append((x["bucket"], x["block"], [pack(total[w], some[e], *(r[e1] for r in few), many[e1], sums[e1])]))
        spread = np.unique(entry[(np.concatenate(flags) & SPREAD) > 0])
        stats = np.bincount(np.minimum(t, GT + 2), minlength=GT + 3)[1 : GT + 2]
        own = [pack(stats, *(x[spread] for x in names), *(r[spread] for r in few), many[spread], sums[spread])]
        size = np.bincount(c, minlength=n)
        full = np.flatnonzero(size)
        own.append(pack(*(steps(x[full]) for x in names), size[full], steps(word[kept]), t))
        return pa.Table.from_batches([sent([*out, (rows[0]["bucket"], -1, own)])])

    return run


def own_sums(order: int):
    """Own rows of buckets to (what, key, values): statistics, and the sums of spread contexts."""
    def run(batches):
        for batch in batches:
            what, values = [], []
            for parts in batch.column(0).to_pylist():
                stats, *got = unpack(parts[0])
                what.append([]), values.append(stats.astype(float).tolist())
                names, nums = got[: order - 1], [x.astype(float) for x in got[order - 1 : -1]] + [got[-1].view(np.float64)]
                what += np.stack(names, axis=1).tolist()
                values += np.stack(nums, axis=1).tolist()
            yield pa.record_batch([pa.array(what, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], ["what", "values"])

    return run


def scores(model: dict, id_type: pa.DataType):
    """Blocks with all answers to a row per document."""
    uni, orders = model["uni"], len(model["bits"]) - 1

    def weights(block: Block, k: int, den_below: np.ndarray | None):
        """(denominator, backoff weight) of each context of order k."""
        level, d = block.levels[k - 1], model["discounts"][k]
        context = level.below.total_as_context.astype(float)
        some, few, many, sums = np.zeros(level.below.nodes, bool), np.zeros((GT, level.below.nodes)), np.zeros(level.below.nodes), np.zeros(level.below.nodes)
        _, own, *numbers = block.answers[k - 2]
        some[level.entry] = own > 0
        need = level.entry[(level.flags & WEIGHT) > 0]
        for r in range(GT):
            few[r, need] = numbers[r]
        many[need], sums[need] = numbers[GT], numbers[GT + 1].view(np.float64)
        heavy = np.flatnonzero(level.below.heavy)
        spread = model["spread"][k]
        for i, key in zip(heavy.tolist(), zip(*(x.tolist() for x in level.below.names(heavy)), strict=True), strict=True):
            v = spread.get(key, [0.0] * (GT + 2))
            few[:, i], many[i], sums[i] = v[:GT], v[GT], v[GT + 1]
            some[i] = any(v[:GT])
        total = np.maximum(context + ~some, 1.0)
        kept = many + (few * (d[1:] * np.arange(1, GT + 1))[:, None]).sum(axis=0)
        if den_below is not None:
            sums = sums / den_below[level.below.last]
        return total, np.where(context > 0, (total - kept) / total / np.maximum(1.0 - sums, 1e-300), 1.0)

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, model, ask=False)
                words = block.levels[0]
                known = words.total[block.tok]
                prob, den = uni(known), None
                for k in range(2, orders + 1):
                    level = block.levels[k - 1]
                    # the node of the context without its first word, as a context of the order below
                    level.last = level.word if k == 2 else level.lower
                    den, weight = weights(block, k, den)
                    count, c = level.total[level.place], level.context[level.place]
                    prob[level.at] = np.where(count > 0, discounted(count, model["discounts"][k]) / den[c], weight[c] * prob[level.at])
                doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
                add = lambda x: np.bincount(doc, x, len(block.sizes))
                base = add(np.log10((known + 0.5) / (model["tokens"] + 0.5 * (model["types"] + 1))))
                yield pa.record_batch([
                    pa.array(row["ids"], id_type), pa.array(~block.train), pa.array(block.sizes, pa.int64()), pa.array(add(known > 0).astype(np.int64)), pa.array(np.full(len(block.sizes), model["tokens"]), pa.int64()), pa.array(base), pa.array(add(np.log10(prob))),
                ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def bits_for(items: int, each: int) -> int:
    return max(0, int(np.ceil(np.log2(max(items, 1) / each))))


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, block_tokens: int = 500_000, model_path: str | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased runs without white space and one end. The model learns from the rows where train is true; the
    others are held out. score is the sum of log10 of Katz's n-gram probability of the given order, of which each order
    falls back on the one below: an n-gram seen in training has its Good-Turing discounted relative frequency; else its
    context's backoff weight times the probability of order n - 1, down to the word's discounted unigram probability, an
    unknown word's being what the discounts free; a context that was not seen has weight 1. The first token's context is
    the text's start, the next one's the start and it. For each context the probabilities of all known words and the unknown
    one sum to 1. base_score: unigrams with 0.5 added to each count. Null text is empty and has the end only. Without
    training rows every word is unknown; an empty table gives no rows. Repeated rows stay repeated; other columns are not
    looked at. Words are told apart by 64-bit hashes. A block and a bucket are in a task's memory: a bucket has about as
    many n-grams as set below, and one more per block for an n-gram that all blocks have. model_path keeps the model's
    tables there, by order and bucket, in packed form.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, put = docs.sparkSession, Scratch()
    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    fed = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    made = fed.mapInArrow(blocker(block_tokens, arrow_id), f"block long, ids array<{kind.simpleString()}>, train array<boolean>, sizes array<long>, tokens binary, words binary, counts binary, n_words long, n_tokens long, train_tokens long, train_docs long")
    tables: list = []

    def bucketed(df: DataFrame) -> DataFrame:
        """df as a table by block, so that answers come to the blocks and not the other way round; replaces the one before."""
        name = f"katz_blocks_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{name}"
        tables.append((name, path))
        with batches_of(spark, BATCH_BYTES):
            df.write.bucketBy(partitions(spark), "block").option("path", path).option("compression", "zstd").saveAsTable(name)
        for old in tables[:-1]:
            dropped(old)
        del tables[:-1]
        return spark.table(name)

    def dropped(table: tuple) -> None:
        found = spark.table(table[0]) if spark.catalog.tableExists(table[0]) else docs
        spark.sql(f"DROP TABLE IF EXISTS {table[0]}")
        found.written_to = table[1]
        forget(found)

    def told(state: DataFrame, got: DataFrame, k: int) -> DataFrame:
        """The blocks with their answers of order k."""
        return state.join(got.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "parts")).alias(f"answers{k}")), "block", "left")

    def stored(got: DataFrame, k: int, skip: int) -> None:
        if model_path:
            got.where("block < 0").select("bucket", F.slice("parts", F.lit(skip), F.size("parts")).alias("parts")).write.partitionBy("bucket").parquet(f"{model_path}/order={k}")

    try:
        state = bucketed(made)
        tokens, train_docs, n_words, n_tokens = (x or 0 for x in state.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum("n_words"), F.sum("n_tokens")).first())
        bits = bits_for(n_words, 250_000)
        model = {"train_docs": train_docs, "tokens": tokens, "threshold": max(tokens, 1) / HEAVY, "bits": [bits] + [bits_for(n_tokens, 1_500_000)] * order, "discounts": {}, "spread": {}}
        asked = state.select("block", "words", "counts").mapInArrow(word_requests(bits), PARTS)
        got = put(asked.groupBy("bucket").applyInArrow(word_answers(bits), PARTS), "katz1")
        del asked
        released(spark)
        own = [r["parts"] for r in got.where("block < 0").select(F.get("parts", F.lit(0)).alias("parts")).toLocalIterator()]  # TOP words and a few numbers a bucket
        own = [unpack(x) for x in own]
        stats = sum((x[0] for x in own), np.zeros(GT + 2, np.int64))
        model |= {"types": int(stats[0]), "uni": Unigrams(np.array([0, *stats[1:]]), tokens)}
        top = np.zeros(TOP + 1, np.int64)
        for _, number, total in own:
            top[number[number <= TOP]] = total[number <= TOP]
        stored(got, 1, 2)
        kept = "block long, ids array<{0}>, train array<boolean>, sizes array<long>, tokens binary, numbers binary, totals binary".format(kind.simpleString())
        kinds = [pa.int64(), pa.list_(arrow_id), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        schema = pa.schema([(c.split()[0], t) for c, t in zip(kept.split(", "), kinds, strict=True)])
        state = bucketed(told(state.select("block", "ids", "train", "sizes", "tokens"), got, 1).mapInArrow(renumbered(schema), kept))
        put.clear()
        released(spark)
        uni = model["uni"]
        mass = lambda word, lower: uni(np.where(word <= TOP, top[np.minimum(word, TOP)], lower))
        for k in range(2, order + 1):
            asked = state.drop("ids").mapInArrow(requests(model), PARTS)
            got = put(asked.groupBy("bucket").applyInArrow(answers(k, mass), PARTS), f"katz{k}")
            del asked
            released(spark)
            sums = got.where("block < 0").select("parts").mapInArrow(own_sums(k), "what array<long>, values array<double>")
            sums = sums.select("what", F.posexplode("values").alias("i", "v")).groupBy("what", "i").agg(F.sum("v").alias("v")).groupBy("what").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
            sums = {tuple(r["what"]): [x["v"] for x in r["v"]] for r in sums.collect()}  # fewer than HEAVY contexts
            d = good_turing(np.array([0, *sums.pop((), [0] * (GT + 1))]))
            model["discounts"][k], model["spread"][k] = d, sums
            stored(got, k, 2)
            mass = lambda word, lower, d=d: discounted(lower, d)
            state = told(state, got, k)
            if k < order:
                state = bucketed(state)
                put.clear()
                released(spark)
        return put.result(state.mapInArrow(scores(model, arrow_id), f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "katzscores").withColumnRenamed("id", id_col)
    finally:
        for table in tables:
            dropped(table)
        put.clear()
