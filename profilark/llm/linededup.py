"""Line deduplication: an exact set-similarity join of lines.

A line is the set of its lower-cased words.  A line is removed when an earlier line (smaller
document id, or the same document and a smaller line number) has Jaccard similarity
``percent`` / 100 or more; whether that earlier line is itself removed makes no difference.

1. One pass counts words over all texts (in 2^22 hashed counters, whatever the vocabulary) and
   fingerprints each line.  Lines equal word by word collapse: only the first goes on.
2. A second pass orders each line's words by rarity (counter, then hash: a total order, so the
   join is exact however words share counters) and emits the prefix that two similar lines must
   share a word of (k words of a prefix k - 1 longer, where lines are long).
3. Lines meet on prefix words, packed by hashed buckets of words, under the length bound, the positional bound and a bound from
   64-bit parity bitmaps (differing bits never exceed the symmetric difference).  Words in the
   prefixes of more than ``hot`` lines first propose every line to the earliest one only; lines
   so resolved need no further partner.  The others are compared with earlier ones of their own
   and the neighbouring bands of length, a hot word's lines in salted parts.
4. Candidates are verified on the full word sets of their lines, the likeliest of each line first.

Definitions.  Lines end at a line feed.  Lines of fewer than ``least_words`` words stay and remove
nothing; lines without words always stay.  Null texts stay null; rows
with a null id are kept as they are and remove nothing.  Rows that share an id and differ in text
are documents of their own, ordered by a 64-bit hash of the text; rows equal in both are one
document and keep the same lines.  A document all of whose lines with words go has an empty text
and ``emptied`` true.  Other columns are kept; one named as an added column gets ``_`` behind it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilark.functions.cluster import discard, materialize, ship, small
from profilark.llm import textscan as ts
from profilark.llm.columns import carried, keyed, named, row_key, typed

BITS = 22
SEGMENTS = 64
WIDTH = (1 << BITS) // SEGMENTS
#: Bytes of text that are worked on at a time.
SLICE = 1 << 19
#: One more shared prefix word is asked for with every so many words of a line, up to so many.
WORDS_STEP, WORDS_MOST = 48, 4
#: Rows that a bucket of words holds on average, and rows that a task packs at a time.
ROWS = 1 << 18
#: Pairs that are held against the bounds at a time.
PAIRS = 1 << 18
#: A hot word's lines are compared in 1 + sqrt(lines / this) salted parts.
PART = 1 << 12


def _lines(w: ts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the running number of its line in the batch; each text's first; each word's text."""
    feed = np.flatnonzero(w.buf == 10)
    text = np.repeat(np.arange(len(w.ptr) - 1), w.count)
    first = np.searchsorted(feed, w.text_ptr[:-1]) + np.arange(len(w.ptr) - 1)
    return np.searchsorted(feed, w.start) + text, first, text


def _starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _scan(least: int):
    names = ["doc", "line", "f1", "f2", "again", "segment", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << BITS, np.uint32), pa.int64()
        for whole in batches:
            kind = whole.schema.field(0).type
            for part in ts.slices(whole, "text", SLICE):
                w = ts.words(part.column(1))
                if not len(w.hash):
                    continue
                np.add.at(counts, (w.hash >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
                line, first, text = _lines(w)
                at = _starts(line)
                size = np.diff(np.append(at, len(line)))
                place = (np.arange(len(line)) - np.repeat(at, size)) % ts.BLOCK
                f1 = ts.mix(np.add.reduceat(w.hash * ts._up[place], at))
                f2 = ts.mix(np.add.reduceat((w.hash ^ np.uint64(0x5851F42D4C957F2D)) * ts._down[place], at) + np.uint64(1))
                long = np.flatnonzero(size >= least)
                at, f1, f2 = at[long], f1[long], f2[long]
                order = np.lexsort((line[at], f2, f1, text[at]))
                a, b = order[1:], order[:-1]
                again = np.zeros(len(at), bool)
                again[a] = (text[at[a]] == text[at[b]]) & (f1[a] == f1[b]) & (f2[a] == f2[b])
                none = pa.nulls(len(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text[at])), pa.array((line[at] - first[text[at]]).astype(np.int32)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(again), none.cast(pa.int32()), none.cast(pa.binary())],
                    names=names,
                )
        for k in range(SEGMENTS):
            own = counts[k * WIDTH : (k + 1) * WIDTH]
            if own.any():
                data = _sparse(own)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (kind, *kinds)), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=names)

    return run


def _sparse(total: np.ndarray) -> bytes:
    some = np.flatnonzero(total)
    return some.astype("<u4").tobytes() + total[some].astype("<i8").tobytes()


def _total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(WIDTH, np.int64)
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("counts")):
            raw = data.as_py()
            n = len(raw) // 12
            total[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)
    return total


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counters of one segment from some of the tasks."""
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_sparse(_total(batches))], pa.binary())], names=["segment", "counts"])


def _levels(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of one segment's counters."""
    level = _level(_total(batches))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["segment", "level"])


def _sorted_sets(w: ts.Words, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash, level) of the distinct words of every line, lines in order, rarest words first."""
    rank = level[(w.hash >> np.uint64(64 - BITS)).astype(np.int64)]
    done = False
    if len(line) and line[-1] < 1 << 24:
        key = line.astype(np.uint64) << np.uint64(40) | rank.astype(np.uint64) << np.uint64(32) | w.hash >> np.uint64(32)
        order = np.argsort(key)
        key, hashes = key[order], w.hash[order]
        done = not ((key[1:] == key[:-1]) & (hashes[1:] != hashes[:-1])).any()
    if not done:
        order = np.lexsort((w.hash, rank, line))
        hashes = w.hash[order]
    line, rank = line[order], rank[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    return line[new], hashes[new], rank[new]


def _level(count: np.ndarray | int) -> np.ndarray:
    """0 for counters of at most one, else a logarithmic level."""
    count = np.asarray(count)
    return np.where(count <= 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 1))))).astype(np.uint8)


def shared_words(n: np.ndarray) -> np.ndarray:
    """The words that two lines must share in their prefixes: more where the smaller one is long."""
    return 1 + np.minimum(n // WORDS_STEP, WORDS_MOST - 1)


def _prefixes(percent: int, least: int, hot: int, shared):
    names = ["doc", "line", "n", "bits", "prefix", "warm"]
    limit = int(_level(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for part in ts.slices(whole, "text", SLICE):
                w = ts.words(part.column(1))
                if not len(w.hash):
                    continue
                line0, first, text = _lines(w)
                at0 = _starts(line0)
                line, hashes, rank = _sorted_sets(w, line0, level)
                at = _starts(line)
                n = np.diff(np.append(at, len(line)))
                number = line[at]
                of = np.searchsorted(first, number, side="right") - 1
                use = np.diff(np.append(at0, len(line0))) >= least  # as repeated words count
                # two sets that share so many words share k of them in prefixes that are k - 1 longer
                same = np.minimum(n, n - (n * percent + 99) // 100 + shared_words(n))
                skip = part.column(2)
                if skip.null_count < len(skip):
                    gone, ptr = skip.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum([len(x) if x.is_valid else 0 for x in skip]))
                    use &= ~np.isin(number, gone + first[np.repeat(np.arange(len(skip)), np.diff(ptr))])
                place = np.arange(len(line)) - np.repeat(at, n)
                taken = (place < np.repeat(np.where(use, same, 0), n)).nonzero()[0]
                token = hashes[taken]
                many = np.where(use, same, 0)
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), at)
                keep = np.flatnonzero(many)
                is_warm = rank[taken] > limit
                row = np.repeat(np.arange(len(keep)), many[keep])
                warm_ptr = np.append(0, np.cumsum(np.bincount(row[is_warm], minlength=len(keep)))).astype(np.int32)
                ptr = np.append(0, np.cumsum(many[keep])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(of[keep])),
                        pa.array((number[keep] - first[of[keep]]).astype(np.int32)),
                        pa.array(n[keep].astype(np.int32)),
                        pa.array(bits[keep].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ptr), pa.array(token.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(warm_ptr), pa.array(token[is_warm].view(np.int64))),
                    ],
                    names=names,
                )

    return run


def _packed(buckets: int, hot):
    """(doc, line, n, bits, prefix) -> (bucket, data): rows (token, doc, line, place, bits) of a bucket, without hot words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(hot.value, np.int64)
        held, count = [], 0
        for batch in batches:
            doc, n, prefix = batch.column(0), batch.column(2).to_numpy().astype(np.int64), batch.column(4)
            many = prefix.value_lengths().to_numpy().astype(np.int64)
            token = prefix.flatten().to_numpy()
            of = np.repeat(np.arange(len(many)), many)
            place = (n << 32 | shared_words(n) << 28)[of] + np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
            if len(known):
                cold = np.flatnonzero(known[np.minimum(np.searchsorted(known, token), len(known) - 1)] != token)
                token, of, place = token[cold], of[cold], place[cold]
            sides = [*_parts(doc), batch.column(1).to_numpy(), batch.column(3).to_numpy()]
            held.append(np.stack([token, place, *(x[of] for x in sides)]))
            count += len(token)
            if count >= ROWS:
                yield from _by_bucket(np.concatenate(held, axis=1), buckets)
                held, count = [], 0
        if count:
            yield from _by_bucket(np.concatenate(held, axis=1), buckets)

    return run


def _parts(doc: pa.Array) -> list[np.ndarray]:
    """The numbers that make a key."""
    return [x.to_numpy() for x in (doc.flatten() if pa.types.is_struct(doc.type) else [doc])]


def _by_bucket(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = (rows[0].view(np.uint64) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")  # by radix where numbers are short
    bucket, rows = bucket[order], rows.take(order, axis=1)
    at = _starts(bucket)
    data = [rows[:, a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(bucket)))]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def _meet(percent: int, fields: list[str]):
    """The packed rows of a bucket -> pairs of lines that meet on a word within the bounds of ``LineDedup._bounds``.

    ``fields`` names the parts of a key that is a struct.
    """
    width = 4 + max(1, len(fields))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), np.int64).reshape(width, -1) for batch in batches for x in batch.column(batch.schema.get_field_index("data"))]
        rows = np.concatenate(held, axis=1)
        del held
        rows = rows.take(np.argsort(rows[0]), axis=1)
        at = _starts(rows[0])
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, rows.shape[1]))) << 32
        order = np.argsort(group | rows[1] >> 32)  # shorter lines first: those that a line meets stand together
        rows = rows.take(order, axis=1)
        token, place, ids, bits = rows[0], rows[1], rows[2:-1], rows[-1]
        n = place >> 32
        own = np.arange(len(token))
        more = np.searchsorted(group | n, group | n * 100 // percent, side="right") - own - 1
        total = np.append(0, np.cumsum(more))
        i = 0
        while i < len(token):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
            a = np.repeat(own[i:j], more[i:j])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], more[i:j])
            i = j
            yield from _near(a, b, place, ids, bits, percent, fields)

    return run


def _near(a: np.ndarray, b: np.ndarray, place: np.ndarray, ids: np.ndarray, bits: np.ndarray, percent: int, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """The pairs within the bounds, the earlier line first."""
    apart = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).astype(np.int32)
    na, nb = place[a] >> 32, place[b] >> 32
    ok = np.flatnonzero(apart * (100 + percent) <= (na + nb) * (100 - percent))
    a, b, apart, na, nb = (x[ok] for x in (a, b, apart, na, nb))
    asked = (np.minimum(place[a], place[b]) >> 28) & 15
    left = np.minimum(na - (place[a] & 268435455), nb - (place[b] & 268435455))
    ok = (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & ((left + asked - 1) * (100 + percent) >= percent * (na + nb))
    later, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for x in ids:
        later |= same & (x[a] > x[b])
        same &= x[a] == x[b]
    ok = np.flatnonzero(ok & ~same)
    if not len(ok):
        return
    first, second = np.where(later, b, a)[ok], np.where(later, a, b)[ok]
    columns = []
    for end in first, second:
        doc = [pa.array(x[end]) for x in ids[:-1]]
        columns += [pa.StructArray.from_arrays(doc, fields) if fields else doc[0], pa.array(ids[-1][end].astype(np.int32))]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(apart[ok]), pa.array(asked[ok])], names=["a_doc", "a_line", "b_doc", "b_line", "apart", "asked"])


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted lines) -> (doc, line, set of word hashes)."""
    for whole in batches:
        for part in ts.slices(whole, "text"):
            w = ts.words(part.column(1))
            line, first, _ = _lines(w)
            docs, lines, sets = [], [], []
            for k, wanted in enumerate(part.column(2)):
                for n in wanted.as_py() or ():
                    a, b = np.searchsorted(line, [first[k] + n, first[k] + n + 1])
                    docs.append(k)
                    lines.append(n)
                    sets.append(np.unique(w.hash[a:b]))
            if docs:
                ptr = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs)), pa.array(lines, pa.int32()), pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc", "line", "set"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed lines, and whether nothing is left of them."""
    for whole in batches:
        for part in ts.slices(whole, "text"):
            texts, emptied = [], []
            for value, lines in zip(part.column(1), part.column(2)):
                text = value.as_py()
                if lines.is_valid and text is not None:
                    gone = set(lines.as_py())
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
                    emptied.append(not text.strip(" \t\n\v\f\r"))
                else:
                    emptied.append(False)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(2), pa.array(emptied)], names=["kept", "text", "lines", "emptied"])


class LineDedup:
    """``removed`` lists the lines that go; ``run`` returns the documents without them."""

    def __init__(self, percent: int = 80, hot: int = 256, least_words: int = 1, id_col: str = "doc_id", text_col: str = "text"):
        if not 50 <= percent <= 100 or hot < 2:
            raise ValueError("percent: 50 to 100; hot: 2 at least")
        self.percent, self.hot, self.least_words, self.id_col, self.text_col = percent, hot, least_words, id_col, text_col

    def _keyed(self, docs: DataFrame) -> DataFrame:
        texts = docs.select(named(self.id_col).cast("long").alias("doc"), named(self.text_col).cast("string").alias("text"))
        return keyed(texts.where("doc is not null and text is not null"), "doc")

    def removed(self, docs: DataFrame) -> DataFrame:
        """``doc, lines`` (sorted numbers from 0) of every document that loses lines.

        ``doc`` is the id; where an id stands on several rows, it is a struct of id and text hash.
        """
        ship(docs.sparkSession)
        texts = self._keyed(docs)
        kind = texts.schema["doc"].dataType.simpleString()
        scan = materialize(texts.mapInArrow(_scan(self.least_words), f"doc {kind}, line int, f1 long, f2 long, again boolean, segment int, counts binary"), "lines")
        level = bytearray(1 << BITS)
        counts = scan.where("segment is not null").select("segment", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("salt"))
        counts = counts.groupBy("segment", "salt").applyInArrow(_add, "segment int, counts binary")
        for row in counts.groupBy("segment").applyInArrow(_levels, "segment int, level binary").collect():
            level[row["segment"] * WIDTH : (row["segment"] + 1) * WIDTH] = row["level"]
        shared = docs.sparkSession.sparkContext.broadcast(bytes(level))

        copies = self._copies(scan.where("segment is null").select("doc", "line", "f1", "f2", "again"))
        gone = materialize(copies.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines")), "copied")
        discard(scan)
        prefixes = materialize(self._with(texts, gone, "left").mapInArrow(_prefixes(self.percent, self.least_words, self.hot, shared), f"doc {kind}, line int, n int, bits long, prefix array<long>, warm array<long>"), "prefixes")
        similar = materialize(self._similar(prefixes, texts), "similar")
        discard(prefixes)
        lines = gone.select("doc", F.explode("lines").alias("line")).unionByName(similar)
        return lines.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))

    def run(self, docs: DataFrame, removed_col: str | None = "removed_lines", emptied_col: str | None = "emptied") -> DataFrame:
        """The documents with the remaining lines as text, the removed line numbers and whether nothing is left."""
        gone = materialize(self.removed(docs), "removed")
        added = [c for c in (removed_col, emptied_col) if c]
        columns = carried(docs.columns, added)
        names = docs.select(*columns).columns
        at = docs.columns.index(self.text_col)
        key = named(self.id_col).cast("long").alias("doc")
        kept = docs.select(F.struct(*(c for k, c in enumerate(columns) if k != at)).alias("kept"), named(self.text_col).cast("string").alias("text"), key)
        if "struct" in gone.schema["doc"].dataType.simpleString():
            kept = kept.withColumn("doc", row_key("doc"))
        kept = self._with(kept, gone, "left").select("kept", "text", "lines")
        out = kept.mapInArrow(_rewrite, typed(kept, "kept", "text string, lines array<int>, emptied boolean"))
        own = [F.col("text").alias(c) if k == at else F.col("kept")[c].alias(c) for k, c in enumerate(names)]
        if removed_col:
            own.append(F.coalesce("lines", F.array().cast("array<int>")).alias(removed_col))
        if emptied_col:
            own.append(F.col("emptied").alias(emptied_col))
        return out.select(*own)

    def _with(self, rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        """Join on doc; the side is broadcast where its bytes prove it small."""
        return rows.join(small(side), "doc", how)

    def _copies(self, lines: DataFrame) -> DataFrame:
        """(doc, line) of all but the first of equal lines."""
        own = lines.where("not again")
        classes = own.groupBy("f1", "f2").agg(F.min("doc").alias("d0"), F.count("*").alias("docs")).where("docs > 1")
        classes = materialize(classes.select("f1", "f2", "d0"), "classes")
        near = small(classes)
        if near is not classes:
            across = own.join(near, ["f1", "f2"])
        else:  # a hot class's lines meet its first document in 8 salted parts
            salt = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
            across = own.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(8)).cast("int")).join(classes.select("*", salt), ["f1", "f2", "salt"])
        return lines.where("again").select("doc", "line").unionByName(across.where("doc != d0").select("doc", "line"))

    def _similar(self, prefixes: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc, line) of lines similar to an earlier one with another sequence of words."""
        # size, words asked for and position share a column, as these rows are the bulk of what is shuffled
        n = F.col("n").cast("long")
        asked = F.least(1 + F.floor(n / WORDS_STEP), F.lit(WORDS_MOST)).cast("long")
        place = F.shiftleft(n, 32) + F.shiftleft(asked, 28) + F.col("pos")
        rows = prefixes.select("doc", "line", "n", "bits", F.posexplode("prefix").alias("pos", "token")).select("token", "doc", "line", place.alias("place"), "bits")
        # only words whose counter is large can stand in many prefixes
        hot = prefixes.select(F.explode("warm").alias("token")).groupBy("token").count().where(F.col("count") > self.hot)
        hot = materialize(hot.select("token", (1 + F.floor(F.sqrt(F.col("count") / PART))).cast("int").alias("parts")), "hot")
        if hot.isEmpty():
            return self._resolved(self._shared(self._meeting(prefixes, hot)), texts)
        known = small(hot)
        warm = materialize(rows.join(known, "token"), "warm")
        if known is hot:  # too many words to send
            rows = rows.join(hot, "token", "left_anti")
            cold = self._pairs(rows, rows)
        else:
            cold = self._meeting(prefixes, hot)
        pivot = warm.groupBy("token").agg(F.min("doc").alias("doc"), F.min_by("line", F.struct("doc", "line")).alias("line"))
        stars = materialize(self._pairs(warm.join(pivot, ["token", "doc", "line"], "left_semi"), warm), "stars")
        found = materialize(self._resolved(stars, texts), "found")
        pairs = cold.unionByName(self._parted(warm, warm.join(found, ["doc", "line"], "left_anti")))
        out = found.unionByName(self._resolved(self._shared(pairs), texts))
        discard(stars)
        return out

    def _parted(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs on hot words: lines meet those of their own and the neighbouring bands of length, in salted parts.

        A band spans a little more than the factor by which similar lines may differ in length, so neighbours suffice.
        """
        step = math.log(100 / self.percent * 1.008) if self.percent < 100 else 0.01
        band = F.floor(F.log(F.shiftright("place", 32).cast("double")) / step).cast("int")
        salt = F.pmod(F.xxhash64("doc", "line"), F.col("parts")).cast("int")
        left = left.withColumn("part", F.struct(band.alias("band"), salt.alias("salt")))
        right = right.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.withColumn("part", F.struct("band", "salt"))
        return self._pairs(left, right, "part")

    def _shared(self, pairs: DataFrame) -> DataFrame:
        """The pairs that share as many prefix words as their shorter line asks for."""
        counted = pairs.groupBy("a_doc", "a_line", "b_doc", "b_line").agg(F.count("*").alias("met"), F.min("apart").alias("apart"), F.min("asked").alias("asked"))
        return materialize(counted.where("met >= asked").drop("met", "asked"), "pairs")

    def _resolved(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc, line) of later lines that are similar to one of their partners: the closest bitmap is
        verified first, and the other partners only of lines that it leaves open."""
        first = pairs.groupBy("b_doc", "b_line").agg(F.min_by(F.struct("a_doc", "a_line"), "apart").alias("a")).select("a.a_doc", "a.a_line", "b_doc", "b_line")
        found = materialize(self._verified(materialize(first, "first"), texts), "found")
        open_ = pairs.join(found.select(F.col("doc").alias("b_doc"), F.col("line").alias("b_line")), ["b_doc", "b_line"], "left_anti")
        rest = materialize(open_.select("a_doc", "a_line", "b_doc", "b_line").distinct(), "rest")
        return found if rest.isEmpty() else found.unionByName(self._verified(rest, texts))

    def _meeting(self, prefixes: DataFrame, hot: DataFrame) -> DataFrame:
        """The pairs on words that are not hot.  Rows are shuffled as packed buckets of words, as many as there are rows for."""
        spark, doc = prefixes.sparkSession, prefixes.schema["doc"].dataType
        kind, fields = doc.simpleString(), doc.names if hasattr(doc, "names") else []
        known = np.sort(np.array([r["token"] for r in hot.select("token").collect()], np.int64))
        buckets = 32 + (prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0) // ROWS
        packed = prefixes.select("doc", "line", "n", "bits", "prefix").mapInArrow(_packed(buckets, spark.sparkContext.broadcast(known.tobytes())), "bucket int, data binary")
        return packed.groupBy("bucket").applyInArrow(_meet(self.percent, fields), f"a_doc {kind}, a_line int, b_doc {kind}, b_line int, apart int, asked long")

    def _pairs(self, left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        a = left.select("token", *more, *(F.col(c).alias(f"a_{c}") for c in ("doc", "line", "place", "bits")))
        b = right.select("token", *more, *(F.col(c).alias(f"b_{c}") for c in ("doc", "line", "place", "bits")))
        return a.join(b, ["token", *more]).where(self._bounds()).select("a_doc", "a_line", "b_doc", "b_line", F.expr("bit_count(a_bits ^ b_bits)").alias("apart"), F.expr(self._asked()).alias("asked"))

    def _asked(self) -> str:
        return "(least(a_place, b_place) >> 28 & 15)"

    def _bounds(self) -> Column:
        """With n words each, two similar lines share p (na + nb) / (100 + p) at least; the cheapest test first."""
        p, na, nb = self.percent, "(a_place >> 32)", "(b_place >> 32)"
        bitmap = f"bit_count(a_bits ^ b_bits) * {100 + p} <= ({na} + {nb}) * {100 - p}"
        earlier = "(a_doc < b_doc or (a_doc = b_doc and a_line < b_line))"
        length = f"{na} * 100 >= {nb} * {p} and {nb} * 100 >= {na} * {p}"
        # this word is one of the first that they share: so many may come before it, the rest after it
        left = f"least({na} - (a_place & 268435455), {nb} - (b_place & 268435455))"
        position = f"({left} + {self._asked()} - 1) * {100 + p} >= {p} * ({na} + {nb})"
        return F.expr(f"{bitmap} and {earlier} and {length} and {position}")

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc, line) of the later line of each pair that is similar enough."""
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")), F.struct(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")))).alias("e"))
        wanted = materialize(ends.select("e.*").groupBy("doc").agg(F.collect_set("line").alias("lines")), "wanted")
        sets = materialize(self._with(texts, wanted, "inner").mapInArrow(_line_sets, f"doc {texts.schema['doc'].dataType.simpleString()}, line int, set array<long>"), "sets")
        a = sets.select(F.col("doc").alias("a_doc"), F.col("line").alias("a_line"), F.col("set").alias("sa"))
        b = sets.select(F.col("doc").alias("b_doc"), F.col("line").alias("b_line"), F.col("set").alias("sb"))
        both = pairs.join(a, ["a_doc", "a_line"]).join(b, ["b_doc", "b_line"])
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * common >= self.percent * (F.size("sa") + F.size("sb") - common)).select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")).distinct()
