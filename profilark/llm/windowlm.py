"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every word is masked in its turn and predicted from the two words on each side; the score of a
document is the sum of its words' conditional log-probabilities

    log p(group | window) + log p(member | group, window)
        [+ log p(beginning | member, window) + log p(word | member, beginning)].

There are ``side`` groups of ``side`` members, ``side`` being 3/2 times the fourth root of the distinct
words (48 at least, a multiple of 4).  The most frequent words fill three quarters of the members, each a member of its own, in
bands of frequency.  All other words share the rest by their last two bytes; inside such a member
a softmax over beginnings, with the corpus's counts as prior, takes the window to the word, and
the last factor comes from exact counts: the most frequent ``in_memory`` words are looked up, the
others are joined.  The network embeds the four neighbours' members and has one tanh layer.

Training.  Words are counted over all documents, and biases start at the log counts.  Every word of
every document is a target once.  The documents fall into ``ROUNDS`` of growing size by a hash, each
round into shards of about ``shard_words`` words by a hash; a shard is trained in the order of a
hash, in minibatches of a fixed size, from the mean of the round before.  So the model depends on
the rows alone, not on how they are partitioned, and each round adds one vector for each shard.
A third of all rows may be copies: their ids spread them.  (Rows equal in id and text meet in one
shard, where they are read in a stream.)

Definitions.  Words are lower-cased runs of anything but white space.  Null and wordless texts have
no words, log-probability 0 and a null mean.  Windows end at the text's ends.  Ids may be null or
repeat; each row is scored by its own text.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilark.functions.cluster import discard, materialize, ship
from profilark.llm import textscan as ts
from profilark.llm.columns import named

LEAST_SIDE = 48
HEADS = 16  # beginnings inside a shared member
EMBED, HIDDEN = 12, 32
SIDES = (-2, -1, 1, 2)
#: The share of the documents, in 256ths, that each round of training takes.
ROUNDS = (16, 48, 192)
BATCH = 4096
BUFFER = 1 << 16  # words that are shuffled at a time
FAN_IN = 32  # vectors of weights that one task adds up
SCORED = 1 << 13  # words that are scored at a time
#: Weights are rounded to this before they are added up, so that no order of adding matters.
GRAIN = 2.0**-14


def side_of(distinct: int) -> int:
    return max(LEAST_SIDE, -(-3 * math.isqrt(math.isqrt(distinct)) // 8) * 4)


@dataclass
class Vocabulary:
    side: int
    own: int  # members 0..own-1 are words of their own
    frequent: np.ndarray  # sorted hashes of these
    place: np.ndarray  # their members
    words: np.ndarray  # sorted hashes of the next most frequent words
    counts: np.ndarray  # their exact counts
    totals: np.ndarray  # words by member
    heads: np.ndarray  # words by (shared member, beginning)

    @property
    def leaves(self) -> int:
        return self.side**2

    @property
    def prior(self) -> np.ndarray:
        total = self.heads.sum(1, keepdims=True)
        return np.log((self.heads + 0.5) / (total + 0.5 * HEADS)).astype(np.float32)


def shape(w: ts.Words) -> np.ndarray:
    """A number from the last two and the first two bytes of each word: ending * HEADS + beginning."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    byte = lambda at: ts.LOWER[w.buf[at]].astype(np.int64)
    two = w.end - w.start > 1
    before = np.where(two, byte(np.maximum(w.end - 2, 0)), 0)
    second = np.where(two, byte(np.minimum(w.start + 1, len(w.buf) - 1)), 0)
    return (byte(w.end - 1) * 31 + before * 7) * HEADS + (byte(w.start) * 5 + second * 3) % HEADS


def shared_member(number, own: int, leaves: int):
    """The member of a shape among those that words share (numbers, arrays or columns)."""
    return number % (leaves - own) + own


def found(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand, and whether it does."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_, keys)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == keys


def members(v: Vocabulary, w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Member and beginning of every word (-1 for words of their own)."""
    number = shape(w)
    out, head = shared_member(number // HEADS, v.own, v.leaves), number % HEADS
    at, hit = found(v.frequent, w.hash)
    out[hit], head[hit] = v.place[at[hit]], -1
    return out, head


def within(v: Vocabulary, w: ts.Words, member: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p(word | member, beginning), as of an unseen word for those that are not in memory; where these are."""
    out, shared = np.zeros(len(member)), np.flatnonzero(head >= 0)
    hashes = w.hash[shared]
    at, hit = found(v.words, hashes)
    n = np.where(hit, v.counts[at] if len(v.counts) else 0.0, 0.0)
    total = v.heads[member[shared] - v.own, head[shared]]
    out[shared] = np.minimum(np.log((n + 0.5) / (np.maximum(total, n) + 1.0)), 0.0)
    return out, shared[~hit]


def shapes(v: Vocabulary) -> list[tuple[int, ...]]:
    """Embeddings (one more for beyond the text), first layer, groups, members, beginnings."""
    s = v.side
    return [(v.leaves + 1, EMBED), (len(SIDES), EMBED, HIDDEN), (HIDDEN,), (HIDDEN, s), (s,), (s, HIDDEN, s), (s, s), (HIDDEN, HEADS), (HEADS,)]


def _surprise(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(softmax - what was there) / n, in place."""
    if z.max() > 60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (np.float32(1 / n) / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    z[np.arange(len(z)), at] -= np.float32(1 / n)
    return z


def _log_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of each row at one place; spoils ``z``."""
    if len(z) and z.max() > 60:
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], np.float32))


def _runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, first, end) of each run of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return list(zip(group[at].tolist(), at.tolist(), [*at[1:].tolist(), len(group)]))


class Network:
    """Weights in one flat vector; ``parts`` are views of it."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None, seed: int = 3):
        sizes = [math.prod(s) for s in shapes(v)]
        if flat is None:
            r = np.random.default_rng(seed)
            flat = np.concatenate([r.normal(0, scale, n).astype(np.float32) for n, scale in zip(sizes, (0.3, 0.3, 0, 0.05, 0, 0.05, 0, 0.05, 0))])
        self.v, self.flat, self.prior = v, flat.astype(np.float32), v.prior
        ends = np.cumsum(sizes)
        self.parts = [self.flat[e - n : e].reshape(s) for e, n, s in zip(ends, sizes, shapes(v))]
        self.cuts = list(zip((ends - sizes).tolist(), ends.tolist()))

    def start(self) -> Network:
        """Biases from the corpus's counts."""
        by = self.v.totals.reshape(self.v.side, -1)
        self.parts[4][:] = np.log((by.sum(1) + 1) / (by.sum() + self.v.side))
        self.parts[6][:] = np.log((by + 0.1) / (by.sum(1, keepdims=True) + 0.1 * self.v.side))
        return self

    def tables(self) -> np.ndarray:
        """The first layer's input from each member at each side."""
        return np.einsum("ce,seh->sch", self.parts[0], self.parts[1])

    def log_probability(self, context: np.ndarray, member: np.ndarray, head: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of member, and of beginning where there is one, given the members around."""
        _, _, b1, w2, b2, w3, b3, w4, b4 = self.parts
        order = np.argsort((member // self.v.side).astype(np.int16), kind="stable")  # a radix sort
        member, head, context = member[order], head[order], context[order]
        h = tables[0][context[:, 0]]
        for s in range(1, len(SIDES)):
            h += tables[s][context[:, s]]
        h += b1
        np.tanh(h, out=h)
        group, inside = np.divmod(member, self.v.side)
        part = _log_at(h @ w2 + b2, group)
        z = np.empty((len(h), self.v.side), np.float32)
        for g, a, b in _runs(group):
            np.matmul(h[a:b], w3[g], out=z[a:b])
            z[a:b] += b3[g]
        part += _log_at(z, inside)
        shared = np.flatnonzero(head >= 0)
        part[shared] += _log_at(h[shared] @ w4 + b4 + self.prior[member[shared] - self.v.own], head[shared])
        out = np.empty(len(part))
        out[order] = part
        return out

    def train(self, context: np.ndarray, member: np.ndarray, head: np.ndarray, state: np.ndarray, rate: float = 0.1) -> None:
        """One step of Adagrad; ``state`` sums squared gradients."""
        embed, first, b1, w2, b2, w3, b3, w4, b4 = self.parts
        squares = [state[a:e].reshape(p.shape) for (a, e), p in zip(self.cuts, self.parts)]

        def step(k: int, grad: np.ndarray, at=...) -> None:
            s = squares[k][at]
            s += grad * grad
            if at is not ...:
                squares[k][at] = s
            grad *= rate / np.sqrt(s + np.float32(1e-8))
            self.parts[k][at] -= grad

        n = len(member)
        order = np.argsort((member // self.v.side).astype(np.int16), kind="stable")  # a radix sort
        member, head, context = member[order], head[order], context[order]
        e = embed[context].reshape(n, -1)
        h = np.tanh(e @ first.reshape(-1, HIDDEN) + b1)
        group, inside = np.divmod(member, self.v.side)
        z = _surprise(h @ w2 + b2, group, n)
        d = z @ w2.T
        step(3, h.T @ z)
        step(4, z.sum(0))
        runs, z = _runs(group), np.empty((n, self.v.side), np.float32)
        for g, a, b in runs:
            np.matmul(h[a:b], w3[g], out=z[a:b])
            z[a:b] += b3[g]
        _surprise(z, inside, n)
        here = np.array([g for g, _, _ in runs])
        inner = np.empty((len(runs), HIDDEN, self.v.side), np.float32)
        for k, (g, a, b) in enumerate(runs):
            d[a:b] += z[a:b] @ w3[g].T
            np.matmul(h[a:b].T, z[a:b], out=inner[k])
        step(5, inner, here)
        step(6, np.add.reduceat(z, [a for _, a, _ in runs], axis=0), here)
        shared = np.flatnonzero(head >= 0)
        if len(shared):
            tail = slice(shared[0], None) if shared[-1] - shared[0] == len(shared) - 1 == n - 1 - shared[0] else shared  # groups of shared members come last
            z = _surprise(h[tail] @ w4 + b4 + self.prior[member[tail] - self.v.own], head[tail], n)
            d[tail] += z @ w4.T
            step(7, h[tail].T @ z)
            step(8, z.sum(0))
        d *= 1 - h * h
        under = (first.reshape(-1, HIDDEN) @ d.T).reshape(len(SIDES), EMBED, n).transpose(1, 0, 2).reshape(EMBED, -1)
        step(1, (e.T @ d).reshape(first.shape))
        step(2, d.sum(0))
        which = context.T.ravel().astype(np.int64)
        some = np.flatnonzero(np.bincount(which, minlength=len(embed)))
        grad = np.empty((len(some), EMBED), np.float32)
        for k in range(EMBED):
            grad[:, k] = np.bincount(which, under[k], len(embed))[some]
        step(0, grad, some)


def windows(c: np.ndarray, ptr: np.ndarray, beyond: int) -> np.ndarray:
    """The members on each side of every word (``beyond`` past the text's ends)."""
    reach = max(map(abs, SIDES))
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    room = np.full(len(c) + 2 * reach * len(ptr), beyond, np.int32)
    at = np.arange(len(c)) + 2 * reach * text + reach
    room[at] = c
    return np.stack([room[at + s] for s in SIDES], axis=1) if len(c) else np.zeros((0, len(SIDES)), np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shape, count), summed over some ten megabytes of text at a time."""
    names = ["word", "shape", "n"]

    def flush(hashes, numbers):
        word, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.concatenate(numbers)[first]), pa.array(n)], names=names)

    hashes, numbers, held = [], [], 0
    for whole in batches:
        for part in ts.slices(whole, "text"):
            w = ts.words(part.column(part.schema.get_field_index("text")))
            hashes.append(w.hash)
            numbers.append(shape(w).astype(np.int32))
            held += len(w.hash)
            if held > 1 << 22:
                yield flush(hashes, numbers)
                hashes, numbers, held = [], [], 0
    if held:
        yield flush(hashes, numbers)


def _train(shared):
    """(shard, text), sorted by shard -> a row of weights, times the words that they were trained on, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, squares = shared.value
        net = state = None
        now, used, held, room = None, 0, 0, []

        def learn(everything: bool) -> None:
            nonlocal used, held, room
            while held >= (1 if everything else BUFFER):
                context, member, head = (np.concatenate(x) for x in zip(*room))
                some = min(held, BUFFER)
                order = np.random.default_rng(used).permutation(some)
                for i in range(0, some, BATCH):
                    at = order[i : i + BATCH]
                    net.train(context[at], member[at], head[at], state)
                used, held = used + some, held - some
                room = [(context[some:], member[some:], head[some:])]

        def result() -> pa.RecordBatch:
            learn(True)
            weights = np.concatenate([np.round(x.astype(np.float64) / GRAIN) * used for x in (net.flat, state)])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([used]), pa.array([weights.tobytes()], pa.binary())], names=["part", "n", "weights"])

        for whole in batches:
            shards = whole.column(0).to_numpy()
            edge = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *edge], [*edge, len(shards)]):
                if b == a:
                    continue
                if shards[a] != now:
                    if used or held:
                        yield result()
                    now, used, held, room = shards[a], 0, 0, []
                    net, state = Network(v, flat.copy()), squares.copy()
                for part in ts.slices(whole.slice(a, b - a), "text"):
                    w = ts.words(part.column(1))
                    if len(w.hash):
                        member, head = members(v, w)
                        room.append((windows(member, w.ptr, v.leaves), member, head))
                        held += len(member)
                        learn(False)
        if used or held:
            yield result()

    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0.0
    for b in batches:
        for k, w in zip(b.column(b.schema.get_field_index("n")).to_pylist(), b.column(b.schema.get_field_index("weights"))):
            n += k
            total = total + np.frombuffer(w.as_py(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "weights"])


def _score(shared, joined: bool):
    """A row of each text, numbered; with ``joined`` its words that are not in memory, as often as they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = shared.value
        net = Network(v, flat)
        tables = net.tables()
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for part in ts.slices(whole, "text"):
                w = ts.words(part.column(1))
                member, head = members(v, w)
                logs, beyond = within(v, w, member, head)
                context = windows(member, w.ptr, v.leaves)
                for i in range(0, len(member), SCORED):
                    at = slice(i, i + SCORED)
                    logs[at] += net.log_probability(context[at], member[at], head[at], tables)
                sums = np.append(0, np.cumsum(logs))
                out = [part.column(0), pa.array(w.count.astype(np.int64)), pa.array(sums[w.ptr[1:]] - sums[w.ptr[:-1]])]
                if joined:
                    ends = np.searchsorted(beyond, w.ptr)
                    out += [pa.array(row + np.arange(len(w.count))), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w.hash[beyond].view(np.int64)))]
                    row += len(w.count)
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_words", "log_probability", "row", "beyond"][: len(out)])

    return run


class WindowLM:
    """``fit`` on a corpus, then ``score`` documents."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 1 << 22, in_memory: int = 1 << 18, seed: int = 3):
        if shard_words < 1 or in_memory < 1:
            raise ValueError("shard_words and in_memory: at least 1")
        self.id_col, self.text_col, self.shard_words, self.in_memory, self.seed = id_col, text_col, shard_words, in_memory, seed
        self.vocabulary: Vocabulary | None = None
        self.beyond: DataFrame | None = None  # what each word that is not in memory adds to a score
        self.network: Network | None = None

    def _texts(self, docs: DataFrame) -> DataFrame:
        ship(docs.sparkSession)
        return docs.select(named(self.id_col).alias("id"), named(self.text_col).cast("string").alias("text"))

    def fit(self, docs: DataFrame) -> WindowLM:
        texts = self._texts(docs)
        v = self._count(texts)
        net = Network(v, seed=self.seed).start()
        state = np.zeros_like(net.flat)
        shards = max(1, round(int(v.totals.sum()) / self.shard_words))
        h = F.xxhash64("text", F.col("id").cast("string"))
        rows = texts.where("text is not null").select("text", h.alias("h")).withColumn("turn", F.pmod(F.shiftright("h", 40), F.lit(sum(ROUNDS))))
        first = 0
        for share in ROUNDS:
            part = rows.where((F.col("turn") >= first) & (F.col("turn") < first + share)).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
            first += share
            shared = docs.sparkSession.sparkContext.broadcast((v, net.flat, state))
            merged = part.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h").select("shard", "text").mapInArrow(_train(shared), "part int, n long, weights binary")
            left = shards
            while left > 1:  # a tree, so that no task adds up more than so many
                left = -(-left // FAN_IN)
                merged = merged.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("part").applyInArrow(_merge, "part int, n long, weights binary")
            merged = merged.first()
            if merged is not None and merged["n"]:
                net_flat, state = np.split(np.frombuffer(merged["weights"], np.float64) * GRAIN / merged["n"], 2)
                net, state = Network(v, net_flat), state.astype(np.float32)
            shared.unpersist()
        self.network = net
        return self

    def _count(self, texts: DataFrame) -> Vocabulary:
        counts = texts.select("text").mapInArrow(_count, "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
        counts = materialize(counts, "words")
        distinct = counts.count()
        side = side_of(distinct)
        leaves, own = side * side, side * side * 3 // 4
        top = counts.orderBy(F.desc("n"), "word").limit(own + self.in_memory).toArrow()
        word, number, times = (top.column(k).to_numpy() for k in ("word", "shape", "n"))
        heads = np.zeros((leaves - own, HEADS))
        for r in counts.groupBy("shape").agg(F.sum("n").alias("n")).collect():  # at most 10,000 endings times HEADS
            heads[r["shape"] // HEADS % (leaves - own), r["shape"] % HEADS] += r["n"]
        np.subtract.at(heads, (number[:own].astype(np.int64) // HEADS % (leaves - own), number[:own].astype(np.int64) % HEADS), times[:own])
        frequent, words = word[:own].view(np.uint64), word[own:].view(np.uint64)
        totals = np.zeros(leaves)
        totals[: len(frequent)] = times[:own]
        totals[own:] = heads.sum(1)
        order, known = np.argsort(frequent), np.argsort(words)
        v = self.vocabulary = Vocabulary(side, own, frequent[order], order.astype(np.int64), words[known], times[own:][known].astype(np.float64), totals, heads)
        self.beyond = None
        if distinct > len(word):
            least = int(times[-1])
            rest = counts.where((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > int(word[-1])))
            total = texts.sparkSession.createDataFrame([(k, x.tolist()) for k, x in enumerate(heads)], "member int, heads array<double>")
            rest = rest.withColumn("member", (F.floor(F.col("shape") / HEADS) % (leaves - own)).cast("int")).join(F.broadcast(total), "member")
            all_ = F.element_at("heads", (F.col("shape") % HEADS + 1).cast("int"))
            share = lambda k: F.least(F.log((k + F.lit(0.5)) / (F.greatest(all_, k) + 1.0)), F.lit(0.0))
            self.beyond = rest.select("word", F.round((share(F.col("n").cast("double")) - share(F.lit(0.0))) * 1e6).cast("long").alias("more"))
        else:
            discard(counts)
        return v

    def score(self, docs: DataFrame) -> DataFrame:
        """``id, n_words, log_probability, mean_log_probability`` of every document."""
        if self.network is None:
            raise ValueError("fit first")
        texts = self._texts(docs)
        shared = docs.sparkSession.sparkContext.broadcast((self.vocabulary, self.network.flat))
        kind = texts.schema["id"].dataType.simpleString()
        columns = f"id {kind}, n_words long, log_probability double"
        if self.beyond is None:
            out = texts.mapInArrow(_score(shared, False), columns)
        else:
            # written first: row numbers must not change between the two reads
            out = materialize(texts.mapInArrow(_score(shared, True), columns + ", row long, beyond array<long>"), "scores")
            more = out.select("row", F.explode("beyond").alias("word")).join(self.beyond, "word").groupBy("row").agg(F.sum("more").alias("more"))
            out = out.drop("beyond").join(more, "row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce(F.col("more"), F.lit(0)) / 1e6)
        out = out.withColumn("log_probability", F.round("log_probability", 3))
        mean = F.when(F.col("n_words") > 0, F.round(F.col("log_probability") / F.col("n_words"), 4))
        return out.select(F.col("id").alias(self.id_col), "n_words", "log_probability", mean.alias("mean_log_probability"))
