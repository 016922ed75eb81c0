"""Benchmark passages inside documents, by a prefix-filtered containment join.

Every ``window`` consecutive words of an item (all of them where it has fewer) are one set
of shingled words to be contained exactly.  Words are ordered by how rarely they occur over
*all* documents; of each window only the rarest word is joined, since a document without it
cannot contain the window (the prefix of a containment join at threshold 1).  The position
of that word fixes where the window would begin: windows that would leave the document are
dropped by length and position, the next rarest word is compared, and what remains is
verified word by word.

The items are a stated query set.  They are read in blocks of at most ``block_bytes`` of
text; a block's index (about 60 times its text) is broadcast.  With more than one block the
documents pass once per block and carry the words hit so far, so nothing is shuffled.

Definitions.  Null or wordless texts have no words and are never hit; null or wordless items
have no windows.  Items of equal id and text count once; a null item id is written as an empty
string.  Repeated documents are marked alike.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilark.functions.cluster import materialize, ship
from profilark.llm import textscan as ts
from profilark.llm.columns import named, typed


@dataclass
class Index:
    """Windows of one block of items; arrays are parallel unless said otherwise."""

    items: list[str]
    words: np.ndarray  # windows x longest window; a window's words from the left
    length: np.ndarray
    offset: np.ndarray  # of the rarest word in the window
    second: np.ndarray  # offset of the next rarest
    owner_ptr: np.ndarray  # windows + 1 offsets into owners
    owners: np.ndarray  # positions in items
    prefix: np.ndarray  # sorted distinct rarest words
    prefix_ptr: np.ndarray  # offsets into by_prefix
    by_prefix: np.ndarray  # windows
    maybe: np.ndarray  # 2^16 booleans on the low bits of the prefix words


def build_index(items: list[tuple[str, str | None]], window: int, frequency: dict[int, int]) -> Index:
    """The index of some (id, text) items; ``frequency`` has the documents' counts by word hash."""
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    column = pa.array([t for _, t in items], pa.string())
    w = ts.words(column, ts.ALNUM)
    for k, (name, _) in enumerate(items):
        own = w.hash[w.ptr[k] : w.ptr[k + 1]].tolist()
        if own:
            for i in range(max(1, len(own) - window + 1)):
                found.setdefault(tuple(own[i : i + window]), set()).add(number[name])
    length = np.array([len(x) for x in found], np.int64)
    matrix = np.zeros((len(found), max(length, default=1)), np.uint64)
    offset, second = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for k, x in enumerate(found):
        matrix[k, : len(x)] = x
        order = sorted(range(len(x)), key=lambda i: (frequency.get(x[i], 0), x[i], i))
        offset[k], second[k] = order[0], order[min(1, len(x) - 1)]
    rarest = matrix[np.arange(len(found)), offset]
    by_prefix = np.argsort(rarest, kind="stable")
    prefix, first = np.unique(rarest[by_prefix], return_index=True)
    maybe = np.zeros(1 << 16, bool)
    maybe[(prefix & np.uint64(0xFFFF)).astype(np.int64)] = True
    owners = [sorted(x) for x in found.values()]
    ptr = np.zeros(len(owners) + 1, np.int64)
    np.cumsum([len(x) for x in owners], out=ptr[1:])
    return Index(names, matrix, length, offset, second, ptr, np.array([y for x in owners for y in x], np.int64), prefix, np.append(first, len(by_prefix)), by_prefix, maybe)


def find(index: Index, w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in these texts."""
    none = np.zeros(0, np.int64)
    if not len(index.prefix) or not len(w.hash):
        return none, none
    at = np.flatnonzero(index.maybe[(w.hash & np.uint64(0xFFFF)).astype(np.uint16)])
    slot = np.searchsorted(index.prefix, w.hash[at])
    slot[slot == len(index.prefix)] = 0
    real = index.prefix[slot] == w.hash[at]
    at, slot = at[real], slot[real]
    starts, wins = [none], [none]
    step = 1 << 15  # words at a time: a frequent word may stand for many windows
    for i in range(0, len(at), step):
        a, s = at[i : i + step], slot[i : i + step]
        many = index.prefix_ptr[s + 1] - index.prefix_ptr[s]
        win = index.by_prefix[np.repeat(index.prefix_ptr[s] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
        pos = np.repeat(a, many)
        start = pos - index.offset[win]
        text = np.searchsorted(w.ptr, pos, side="right") - 1
        fits = (start >= w.ptr[text]) & (start + index.length[win] <= w.ptr[text + 1])
        start, win = start[fits], win[fits]
        near = w.hash[start + index.second[win]] == index.words[win, index.second[win]]
        start, win = start[near], win[near]
        for k in range(index.words.shape[1]):
            within = k < index.length[win]
            same = ~within
            same[within] = w.hash[start[within] + k] == index.words[win[within], k]
            start, win = start[same], win[same]
        starts.append(start)
        wins.append(win)
    return np.concatenate(starts), np.concatenate(wins)


def _count(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        maybe = np.zeros(1 << 16, bool)
        maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        total = np.zeros(len(known) + 1, np.int64)
        for whole in batches:
            for part in ts.slices(whole, "text"):
                h = ts.words(part.column(0), ts.ALNUM).hash
                h = h[maybe[(h & np.uint64(0xFFFF)).astype(np.uint16)]]
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                total += np.bincount(np.where(known[at] == h, at, len(known)), minlength=len(known) + 1) if len(known) else 0
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    return run


def _mark(shared, last: bool, whole_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            for part in ts.slices(whole, "text"):
                w = ts.words(part.column(1), ts.ALNUM)
                start, win = find(index, w)
                delta = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(delta, start, 1)
                np.add.at(delta, start + index.length[win], -1)
                hit = np.cumsum(delta[:-1]) > 0
                text = np.searchsorted(w.ptr, start, side="right") - 1
                seen: dict[int, set[str]] = {}
                if len(text):
                    for t, v in np.unique(np.stack([text, win]), axis=1).T.tolist():
                        seen.setdefault(t, set()).update(index.items[k] for k in index.owners[index.owner_ptr[v] : index.owner_ptr[v + 1]])
                for k in range(len(part)):
                    before = part.column(2)[k].as_py() if part.column(2).null_count < len(part) else None
                    if before:
                        bits = np.unpackbits(np.frombuffer(before, np.uint8), count=int(w.ptr[k + 1] - w.ptr[k])).astype(bool)
                        hit[w.ptr[k] : w.ptr[k + 1]] |= bits
                    names = part.column(3)[k].as_py() if part.column(3).null_count < len(part) else None
                    if names:
                        seen.setdefault(k, set()).update(names)
                if not last:
                    marks = [np.packbits(hit[w.ptr[k] : w.ptr[k + 1]]).tobytes() if k in seen else None for k in range(len(part))]
                    items = [sorted(seen[k]) if k in seen else None for k in range(len(part))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "marks", "items"])
                    continue
                sums = np.append(0, np.cumsum(hit))
                spans = [None] * len(part)
                for k in seen:
                    edge = np.diff(np.concatenate([[0], hit[w.ptr[k] : w.ptr[k + 1]], [0]]).astype(np.int8))
                    spans[k] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                items = [sorted(seen.get(k, ())) for k in range(len(part))]
                out = [part.column(0), pa.array(w.count.astype(np.int64)), pa.array((sums[w.ptr[1:]] - sums[w.ptr[:-1]]).astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
                out += [part.column(1)] * whole_text
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_words", "n_hit", "items", "spans", "text"][: len(out)])

    return run


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Decontaminator:
    """``run(docs, items)`` returns ``id, n_words, n_hit, items, spans`` for every document."""

    def __init__(self, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 1 << 20):
        if window < 1 or block_bytes < 1:
            raise ValueError("window and block_bytes: at least 1")
        self.window, self.id_col, self.text_col, self.item_col, self.item_text_col, self.block_bytes = window, id_col, text_col, item_col, item_text_col, block_bytes

    def run(self, docs: DataFrame, items: DataFrame, whole_text: bool = False) -> DataFrame:
        """See above; with ``whole_text`` also ``text``, as it comes back from the worker that read it."""
        spark = docs.sparkSession
        ship(spark)
        empty = F.lit(None)
        rest = docs.select(named(self.id_col).alias("id"), named(self.text_col).cast("string").alias("text"), empty.cast("binary").alias("marks"), empty.cast("array<string>").alias("items"))
        wanted = items.select(F.coalesce(F.col(self.item_col).cast("string"), F.lit("")).alias("item"), F.col(self.item_text_col).cast("string").alias("body")).where("body is not null").distinct()
        size = wanted.agg(F.sum(F.octet_length("body") + F.octet_length("item") + 16)).first()[0] or 0
        blocks = max(1, -(-size // self.block_bytes))
        part = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))
        for k in range(blocks):
            own = [tuple(r) for r in wanted.where(part == k).collect()]
            index = spark.sparkContext.broadcast(build_index(own, self.window, self._frequency(docs, own)))
            if k < blocks - 1:
                rest = materialize(rest.mapInArrow(_mark(index, False), rest.schema), "marks")
            else:
                rest = rest.mapInArrow(_mark(index, True, whole_text), typed(rest, "id", "n_words long, n_hit long, items array<string>, spans array<struct<first: int, last: int>>" + ", text string" * whole_text))
        return rest.withColumnRenamed("id", self.id_col)

    def _frequency(self, docs: DataFrame, own: list[tuple[str, str]]) -> dict[int, int]:
        """How often each word of these items occurs in all documents."""
        known = np.unique(ts.words(pa.array([t for _, t in own], pa.string()), ts.ALNUM).hash)
        shared = docs.sparkSession.sparkContext.broadcast(known)
        counts = docs.select(F.col(self.text_col).cast("string").alias("text")).mapInArrow(_count(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return {r["word"] % (1 << 64): r["n"] for r in counts.collect()}  # at most the block's words


def digest(marked: DataFrame) -> DataFrame:
    """``n_items``, ``items_sha256`` and ``contaminated`` from the operator's columns."""
    return marked.select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
