"""Language of words and documents in code-switched text: a linear-chain conditional random field.

A word (a run of ASCII letters and bytes of non-ASCII characters, lower-cased) has features: itself
(lexicon), its first 2 and 3 and last 2, 3 and 4 bytes (affixes), and its byte trigrams, all hashed
into one weight table.  Label transitions are learned.  Training sequences splice segments of
labelled documents of several languages, so that switches occur; the conditional likelihood is
maximised by Adagrad on forward-backward expectations.  Words are labelled by their forward-backward
posteriors over the whole text; a document takes the label with the largest mean posterior, which is
its score.

Training rows are a bounded sample: at most ``sample_docs`` documents for each label, those with the
smallest hash of text and id, of at most ``sample_bytes`` each; no more than these reach the driver.
Texts are predicted whole, in batches; the language column, ids and sources are never inputs.

Definitions.  Null text, or one without any letter, is ``und`` with score 0.  With no training row
all texts are ``und``.  Ids may be null or repeat.  Ties go to the first label in code point order.
A carried column that is named as an added one gets ``_`` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from profilark.functions.cluster import materialize, ship, small
from profilark.llm import textscan as ts
from profilark.llm.columns import fresh, named, renamed, typed

BITS = 18
SIZE = 1 << BITS
GRAM_BITS = 16
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # labels x SIZE, lexicon and affixes
    grams: np.ndarray  # labels x 2^GRAM_BITS, trigrams
    bias: np.ndarray
    move: np.ndarray  # labels x labels, log potentials from row to column


def _slots(w: ts.Words) -> np.ndarray:
    """words x 6 hashed lexicon and affix features."""
    b = ts.LOWER[w.buf].astype(np.uint64)
    b = np.concatenate([b, np.zeros(4, np.uint64)])
    n = w.end - w.start
    at = lambda i, ok: np.where(ok, b[np.maximum(i, 0)], 0)
    first = [at(w.start + k, n > k) for k in range(3)]
    last = [at(w.end - 1 - k, n > k) for k in range(4)]
    p2 = first[0] << 8 | first[1]
    p3 = p2 << 8 | first[2]
    s2 = last[1] << 8 | last[0]
    s3 = last[2] << 16 | s2
    s4 = last[3] << 24 | s3
    out = np.empty((len(n), 6), np.int32)
    top = np.uint64(64 - BITS)
    out[:, 0] = w.hash >> top
    for k, x in enumerate((p2, p3, s2, s3, s4), 1):
        x = (x | np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> top
    return out


def _trigrams(w: ts.Words) -> np.ndarray:
    """The hashed trigram that begins at every byte of the buffer."""
    b = np.concatenate([ts.LOWER[w.buf], np.zeros(2, np.uint8)]).astype(np.uint32)
    x = b[:-2] << 16
    x |= b[1:-1] << 8
    x |= b[2:]
    x *= np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)


def emissions(model: Model, w: ts.Words) -> np.ndarray:
    """words x labels scores; trigrams within a word are averaged."""
    n = len(w.start)
    out = np.empty((n, len(model.labels)), np.float32)
    if not n:
        return out
    slot = _slots(w)
    gram = _trigrams(w)
    # trigrams start at start .. max(start, end - 3); the bytes between are cut out by pairs of offsets
    stop = np.maximum(w.start + 1, w.end - 2)
    cut = np.empty(2 * n, np.int64)
    cut[::2], cut[1::2] = w.start, stop
    if cut[-1] >= len(gram):
        gram = np.append(gram, np.uint16(0))
    share = (1 / (stop - w.start)).astype(np.float32)
    for k in range(len(model.labels)):
        e = np.add.reduceat(model.grams[k][gram], cut)[::2]
        e *= share
        e += model.bias[k]
        for j in range(slot.shape[1]):
            e += model.weights[k][slot[:, j]]
        out[:, k] = e
    return out


def posteriors(scores: np.ndarray, ptr: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward-backward over every text (rows ptr[i] .. ptr[i+1]): words x labels marginals."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    begin, size = ptr[:-1][order], size[order]
    pot = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(move - move.max()).astype(np.float32)
    alpha = np.empty_like(pot)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # texts with more than t words
    state = None
    for t in range(longest):
        at = begin[: active[t]] + t
        p = pot[at]
        state = p if state is None else (state[: active[t]] @ step) * p
        state = state / state.sum(1, keepdims=True)
        alpha[at] = state
    back = None
    tail = step.T.copy()
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        beta = np.ones((active[t], pot.shape[1]), np.float32)
        if back is not None:
            beta[: len(back)] = back
        p = pot[at]
        mass = alpha[at] * beta
        alpha[at] = mass / mass.sum(1, keepdims=True)
        back = (beta * p) @ tail
        back /= back.sum(1, keepdims=True)
    return alpha


def train(texts: list[tuple[str, str]], rounds: int = 500, chains: int = 48, length: int = 96, seed: int = 11) -> Model:
    """Fit on (label, text) rows; spliced sequences of ``length`` words, ``chains`` at a time."""
    labels = sorted({label for label, _ in texts})
    r, L = np.random.default_rng(seed), len(labels)
    model = Model(labels, np.zeros((L, SIZE), np.float32), np.zeros((L, 1 << GRAM_BITS), np.float32), np.zeros(L, np.float32), np.zeros((L, L), np.float32))
    w = ts.words(pa.array([t for _, t in texts], pa.string()), LETTER)
    if L < 2 or not len(w.start):
        return model
    slot, gram = _slots(w), _trigrams(w)
    stop = np.maximum(w.start + 1, w.end - 2)
    gram = np.append(gram, np.uint16(0))
    label_of = np.repeat(np.array([labels.index(label) for label, _ in texts]), w.count)
    by_label = [np.flatnonzero(label_of == k) for k in range(L)]
    usable = [k for k in range(L) if len(by_label[k])]
    edge = np.zeros((L, L))
    g_w, g_g, g_b, g_m = (np.full(x.shape, 1e-3) for x in (model.weights, model.grams, model.bias, edge))
    for _ in range(rounds):
        pick = np.empty((chains, length), np.int64)
        for c in range(chains):
            at = 0
            while at < length:
                n = min(length - at, int(r.integers(6, 48)))
                pool = by_label[usable[r.integers(len(usable))]]
                i = int(r.integers(len(pool)))
                pick[c, at : at + n] = pool[(i + np.arange(n)) % len(pool)]
                at += n
        flat = pick.ravel()
        many = stop[flat] - w.start[flat]
        row = np.repeat(np.arange(len(flat)), many)
        g = gram[np.repeat(w.start[flat] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
        share = (1 / many).astype(np.float32)
        s = slot[flat]
        gold = label_of[flat]
        scores = np.empty((len(flat), L), np.float32)
        for k in range(L):
            scores[:, k] = np.bincount(row, model.grams[k][g], len(flat)) * share + model.weights[k][s].sum(1) + model.bias[k]
        post, pairs = _expectations(scores.reshape(chains, length, L), model.move)
        gold2 = gold.reshape(chains, length)
        np.add.at(pairs, (gold2[:, :-1].ravel(), gold2[:, 1:].ravel()), -1.0)
        d = post.reshape(-1, L)
        d[np.arange(len(flat)), gold] -= 1
        for k in range(L):
            for grad, total, weight, rate in (
                (np.bincount(s.ravel(), np.repeat(d[:, k], s.shape[1]), SIZE), g_w[k], model.weights[k], 0.25),
                (np.bincount(g, (d[:, k] * share)[row], 1 << GRAM_BITS), g_g[k], model.grams[k], 0.5),
            ):
                some = np.flatnonzero(grad)
                total[some] += grad[some] ** 2
                weight[some] -= rate * grad[some] / np.sqrt(total[some])
        for grad, total, weight in ((d.sum(0), g_b, model.bias), (pairs, g_m, model.move)):
            total += grad**2
            weight -= (0.05 * grad / np.sqrt(total)).astype(np.float32)
    return model


def _expectations(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed pair marginals of chains of equal length."""
    pot = np.exp(scores - scores.max(2, keepdims=True)).astype(np.float64)
    step = np.exp(move.astype(np.float64))
    n, T, L = pot.shape
    alpha, beta = np.empty_like(pot), np.empty_like(pot)
    state = pot[:, 0] / pot[:, 0].sum(1, keepdims=True)
    alpha[:, 0] = state
    for t in range(1, T):
        state = (state @ step) * pot[:, t]
        state /= state.sum(1, keepdims=True)
        alpha[:, t] = state
    state = np.ones((n, L))
    beta[:, -1] = state
    for t in range(T - 2, -1, -1):
        state = (state * pot[:, t + 1]) @ step.T
        state /= state.sum(1, keepdims=True)
        beta[:, t] = state
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    both = alpha[:, :-1, :, None] * step * (beta[:, 1:] * pot[:, 1:])[:, :, None, :]
    both /= both.sum((2, 3), keepdims=True)
    return post, both.sum((0, 1))


def _has_letter(buf: np.ndarray, text_ptr: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = LETTER.copy()
    ascii_letter[0x80:] = False
    sums = np.append(0, np.cumsum(ascii_letter[buf], dtype=np.int64))
    out = sums[text_ptr[1:]] > sums[text_ptr[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in buf[text_ptr[k] : text_ptr[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, ts.Words, np.ndarray]:
    """Label and score of each text; its words and their posteriors."""
    w = ts.words(column, LETTER)
    letter = _has_letter(w.buf, w.text_ptr)
    if not model.labels:
        return [UNKNOWN] * len(column), np.zeros(len(column)), w, np.zeros((len(w.start), 0), np.float32)
    post = posteriors(emissions(model, w), w.ptr, model.move) if len(w.start) else np.zeros((0, len(model.labels)), np.float32)
    sums = np.zeros((len(post) + 1, len(model.labels)))
    np.cumsum(post, axis=0, out=sums[1:], dtype=np.float64)
    mean = (sums[w.ptr[1:]] - sums[w.ptr[:-1]]) / np.maximum(w.count, 1)[:, None]
    best = mean.argmax(1)
    score = np.where(letter, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
    return [model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())], score, w, post


def _label(shared, whole_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in ts.slices(whole, "text"):
                names, score, _, _ = predict(shared.value, part.column(1))
                out = [part.column(0), pa.array(names, pa.string()), pa.array(score)] + [part.column(1)] * whole_text
                yield pa.RecordBatch.from_arrays(out, names=["rest", "lang_pred", "score", "text"][: len(out)])

    return run


def _label_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in ts.slices(whole, "text"):
                model = shared.value
                _, _, w, post = predict(model, part.column(1))
                best = post.argmax(1) if len(post) and model.labels else np.zeros(len(w.start), int)
                for k in range(len(part)):
                    a, b = w.ptr[k], w.ptr[k + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([k] * int(b - a), pa.int64())),
                            pa.array(np.arange(b - a)),
                            pa.array([w.buf[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.start[a:b], w.end[a:b])], pa.string()),
                            pa.array([model.labels[j] if model.labels else UNKNOWN for j in best[a:b]], pa.string()),
                        ],
                        names=["rest", "word_no", "word", "lang_pred"],
                    )

    return run


class LanguageTagger:
    """``fit`` on labelled rows, then ``run`` (documents) or ``words`` (each word)."""

    def __init__(self, text_col: str = "text", label_col: str = "lang", sample_docs: int = 400, sample_bytes: int = 50_000, rounds: int = 500):
        self.text_col, self.label_col, self.sample_docs, self.sample_bytes, self.rounds = text_col, label_col, sample_docs, sample_bytes, rounds
        self.model: Model | None = None

    def fit(self, labelled: DataFrame, id_col: str = "doc_id") -> LanguageTagger:
        """Learn from the rows that have a label and a text of at most ``sample_bytes``."""
        text, label = named(self.text_col).cast("string"), named(self.label_col).cast("string")
        rows = labelled.select(label.alias("label"), text.alias("text"), named(id_col).cast("string").alias("id")).where("label is not null and text is not null")
        rows = rows.where(F.octet_length("text") <= self.sample_bytes).withColumn("h", F.xxhash64("text", "id"))
        # a limit by rank keeps the smallest of each task, so skew or equal ids gather nothing; first on the
        # hashes alone, so that hardly more texts are moved than are taken
        nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
        least = rows.select("label", "h").withColumn("nth", nth).where(F.col("nth") <= self.sample_docs).groupBy("label").agg(F.max("h").alias("least"))
        near = rows.join(small(materialize(least, "least")), "label").where("h <= least")
        nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
        taken = near.withColumn("nth", nth).where(F.col("nth") <= self.sample_docs).select("label", "text", "nth").collect()
        per: dict[str, list] = {}
        for r in sorted(taken, key=lambda r: (r["label"], r["nth"])):
            per.setdefault(r["label"], []).append((r["label"], r["text"]))
        self.model = train([x for name in sorted(per) for x in per[name]], self.rounds)
        return self

    def _shared(self, docs: DataFrame):
        if self.model is None:
            raise ValueError("fit first")
        ship(docs.sparkSession)
        return docs.sparkSession.sparkContext.broadcast(self.model)

    def run(self, docs: DataFrame, *carry: str | Column) -> DataFrame:
        """The ``carry`` columns with ``lang_pred`` and ``score`` for every row.

        Where the text is carried it comes back from the worker that read it, so it is sent there once.
        """
        added = ["lang_pred", "score"]
        names = docs.select(*carry).columns
        whole = renamed(names, added)
        plain = {c for c in carry if isinstance(c, str)}
        back = [self.text_col in plain and c == self.text_col for c in names]
        rows = docs.select(*carry, named(self.text_col).cast("string").alias(fresh("text", whole))).toDF(*whole, own := fresh("text", whole))
        rest = [named(c) for c, b in zip(whole, back) if not b] or [F.lit(0).alias("none")]
        rows = rows.select(F.struct(*rest).alias("rest"), named(own).alias("text"))
        out = rows.mapInArrow(_label(self._shared(docs), any(back)), typed(rows, "rest", "lang_pred string, score double" + ", text string" * any(back)))
        return out.select(*(F.col("text").alias(c) if b else F.col("rest")[c].alias(c) for c, b in zip(whole, back)), *added)

    def words(self, docs: DataFrame, *carry: str | Column) -> DataFrame:
        """One row per word: the ``carry`` columns, its number, itself and its label."""
        added = ["word_no", "word", "lang_pred"]
        names = docs.select(*carry).columns
        rows = docs.select(F.struct(*carry).alias("rest"), named(self.text_col).cast("string").alias("text"))
        out = rows.mapInArrow(_label_words(self._shared(docs)), typed(rows, "rest", "word_no long, word string, lang_pred string"))
        return out.select(*(F.col("rest")[c].alias(n) for c, n in zip(names, renamed(names, added))), *added)


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
