"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. One pass over the texts makes each document's distinct word shingles, a 128-bit
   fingerprint of the set, 128 MinHash values, their low 4 bits packed into 8 longs, and
   32 keys over bands of 4 values (a pair at similarity 0.8 shares none with
   probability (1 - 0.8^4)^32 = 5e-8).
2. Equal sets collapse to the smallest id; only those representatives are compared.
3. Each band bucket proposes its members against two pivots (a star, linear in the bucket).
   A pair's packed signatures are compared 16 values at a time; as soon as the posterior
   probability of the wanted similarity falls below ``miss`` the pair goes (BayesLSH-Lite).
4. Survivors are verified on the full sets in three rounds, the likeliest partners of a document
   first; verified links contract to components, and pairs inside one need no more work.
5. Buckets that still hold several components are compared across these components, so no
   link is lost to the choice of pivots: sets of the same and neighbouring bands of size, a large
   bucket in salted parts.  Pairs are streamed through the signature test inside the join; only
   survivors are ever written.

Definitions.  A null or wordless text has no shingles, links with nothing and is its own
component.  A null id gives a null component and ``kept`` true.  Rows that share an id and differ
in text are each placed by their own text; their component is named by the smallest id in it.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from profilark.functions.cluster import discard, materialize, ship, small
from profilark.llm import textscan as ts
from profilark.llm.columns import keyed, named
from profilark.llm.graph import components

PERMUTATIONS, ROWS = 128, 4
BANDS = PERMUTATIONS // ROWS
PACKED = PERMUTATIONS // 16
#: How many of a document's likeliest partners are verified in each round; the last takes all that are left.
WIDTHS = (1, 16, None)
#: A bucket's sets are compared in 1 + sqrt(sets / this) salted parts.
PART = 1 << 10

_rng = np.random.default_rng(1997)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and where each begins."""
    w = ts.words(column)
    sets = [ts.text_shingles(w.hash[w.ptr[i] : w.ptr[i + 1]], n) for i in range(len(w.ptr) - 1)]
    ptr = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ptr[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ptr


def minhash(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """PERMUTATIONS x sets; the sets must not be empty."""
    out = np.empty((PERMUTATIONS, len(ptr) - 1), np.uint64)
    tmp = np.empty_like(values)
    for p in range(PERMUTATIONS):
        np.multiply(values, _A[p], out=tmp)
        np.add(tmp, _B[p], out=tmp)
        np.minimum.reduceat(tmp, ptr[:-1], out=out[p])
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in ts.slices(whole, "text"):
                values, ptr = shingle_sets(part.column(1), n)
                size = np.diff(ptr)
                some = np.flatnonzero(size)
                docs = len(size)
                fp = np.zeros((2, docs), np.uint64)
                packed = np.zeros((PACKED, docs), np.uint64)
                bands = np.zeros((len(some), BANDS), np.uint64)
                if len(some):
                    own = np.append(ptr[:-1][some], ptr[-1])
                    fp[0, some] = np.add.reduceat(ts.mix(values ^ np.uint64(0x5851F42D4C957F2D)), own[:-1])
                    fp[1, some] = np.add.reduceat(ts.mix(values * np.uint64(0x2545F4914F6CDD1D)), own[:-1])
                    low = minhash(values, own)
                    for k in range(PACKED):
                        for i in range(16):
                            packed[k, some] |= (ts.mix(low[16 * k + i]) & np.uint64(15)) << np.uint64(4 * i)
                    for k in range(BANDS):
                        keys = sum(low[ROWS * k + i] * _MIX[k, i] for i in range(ROWS))
                        bands[:, k] = ts.mix(keys + np.uint64(k))
                counts = np.where(size > 0, BANDS, 0)
                offsets = np.zeros(docs + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), _longs(fp[0]), _longs(fp[1]), *(_longs(p) for p in packed), pa.ListArray.from_arrays(pa.array(offsets), _longs(bands.ravel()))],
                    names=["id", "n", "f1", "f2", *(f"s{k}" for k in range(PACKED)), "bands"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in ts.slices(whole, "text"):
                values, ptr = shingle_sets(part.column(1), n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), _longs(values))], names=["id", "set"])

    return run


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in ts.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(shingle_sets(part.column(1), n)[1]))], names=["n"])

    return run


def posterior_cutoffs(threshold: float, miss: float, batch: int = 16, batches: int = PACKED, bits: int = 4) -> list[int]:
    """Fewest agreements after each batch at which P(similarity >= threshold | agreements) >= miss, under a uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    agree = grid + (1 - grid) / 2**bits
    out = []
    for k in range(1, batches + 1):
        n = batch * k
        for m in range(n + 1):
            logs = m * np.log(agree) + (n - m) * np.log1p(-agree)
            mass = np.exp(logs - logs.max())
            if mass[grid >= threshold].sum() >= miss * mass.sum():
                out.append(m)
                break
    return out


def _agreements(a: str, b: str, k: int) -> Column:
    x = F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def surviving(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (columns a, b, as0.., bs0.., an, bn) that pass the size bound and every batch; adds ``m``, all agreements."""
    cut = posterior_cutoffs(threshold, miss)
    each = [_agreements("a", "b", k) for k in range(PACKED)]
    fits = F.least("an", "bn") >= F.floor(F.greatest("an", "bn") * threshold)
    for k in range(PACKED):
        fits = fits & (reduce(Column.__add__, each[: k + 1]) >= cut[k])
    return pairs.where(fits).select("a", "b", reduce(Column.__add__, each).cast("int").alias("m"))


def _side(reps: DataFrame, side: str, *more: str | Column) -> DataFrame:
    return reps.select(*more, F.col("id").alias(side), F.col("n").alias(f"{side}n"), *(F.col(f"s{k}").alias(f"{side}s{k}") for k in range(PACKED)))


class NearDuplicates:
    """The operator; ``run`` returns ``id, n_shingles, component_id, kept`` for every row."""

    def __init__(self, shingle: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"):
        if not 2 <= shingle <= 32:
            raise ValueError("shingle: 2 to 32 words")
        self.shingle, self.percent, self.miss, self.id_col, self.text_col = shingle, percent, miss, id_col, text_col

    def run(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(named(self.id_col).cast("long").alias("id"), named(self.text_col).cast("string").alias("text"))
        whole = keyed(rows.where("id is not null"), "id")
        out = self.placed(whole)
        if "struct" in whole.schema["id"].dataType.simpleString():
            out = out.select(F.col("id.id").alias("id"), "n", F.col("component.id").alias("component"))
        unnamed = rows.where("id is null").mapInArrow(_sizes(self.shingle), "n long").select(F.lit(None).cast("long").alias("id"), "n", F.lit(None).cast("long").alias("component"))
        out = out.unionByName(unnamed)
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

    def placed(self, texts: DataFrame) -> DataFrame:
        """``id, n, component`` of rows of ``id, text``: ids of any type that sorts, none null, one for each text."""
        ship(texts.sparkSession)
        kind = texts.schema["id"].dataType.simpleString()
        schema = f"id {kind}, n long, f1 long, f2 long, " + ", ".join(f"s{k} long" for k in range(PACKED)) + ", bands array<long>"
        feats = materialize(texts.mapInArrow(_features(self.shingle), schema), "minhash")
        some = feats.where("n > 0")

        groups = some.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        groups = materialize(groups.where("copies > 1"), "copies")
        # a hot group's rows meet their representative in 8 salted parts
        salted = groups.select("f1", "f2", "rep", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
        placed = some.select("id", "n", "f1", "f2", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("salt")).join(salted, ["f1", "f2", "salt"], "left")
        placed = materialize(placed.select("id", "n", F.coalesce("rep", "id").alias("rep")), "placed")
        others = placed.where("rep != id").select("id").distinct()
        reps = some.join(others, "id", "left_anti")

        links = self._links(reps, texts)
        found = components(links)
        out = placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
        return out.unionByName(feats.where("n = 0").select("id", "n", F.col("id").alias("component")))

    def _links(self, reps: DataFrame, texts: DataFrame) -> DataFrame:
        """Verified links (a, b) that connect the representatives as all links would."""
        share = self.percent / 100
        keyed_ = reps.select("id", F.explode("bands").alias("key"))
        pivots = keyed_.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q"))
        buckets = materialize(keyed_.join(pivots.where("p < q"), "key"), "buckets")
        stars = buckets.select(F.explode(F.array("p", "q")).alias("x"), "id").where("x != id")
        stars = stars.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
        sides = materialize(reps.join(buckets.select("id").distinct(), "id", "left_semi").drop("bands"), "sides")
        pool = materialize(surviving(stars.join(_side(sides, "a"), "a").join(_side(sides, "b"), "b"), share, self.miss), "stars")
        sets = self._fetch(texts, pool)
        links, tested = self._verify(pool, sets, None)
        discard(sets)

        comp = materialize(components(links), "comp") if links is not None else None
        rows = buckets.select("key", "id").join(sides, "id")
        if comp is not None:
            rows = rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        else:
            rows = rows.withColumn("c", F.col("id"))
        mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("sets")).where("lo < hi")
        mixed = mixed.select("key", (1 + F.floor(F.sqrt(F.col("sets") / PART))).cast("int").alias("parts"))
        across = surviving(self._parted(rows.join(mixed, "key")), share, self.miss).distinct()
        if tested is not None:
            across = across.join(tested, ["a", "b"], "left_anti")
        pool = materialize(across, "across")
        if pool.isEmpty():
            return links if links is not None else pool.select("a", "b")
        sets = self._fetch(texts, pool)
        more, _ = self._verify(pool, sets, links)
        discard(sets)
        return more if more is not None else pool.select("a", "b").limit(0)

    def _parted(self, rows: DataFrame) -> DataFrame:
        """Pairs of one bucket and two components.

        A band spans a little more than the factor by which similar sets may differ in size, so neighbours suffice.
        """
        step = math.log(100 / self.percent * 1.008) if self.percent < 100 else 0.01
        rows = materialize(rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int")), "mixed")
        salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        left = _side(rows, "a", "key", "band", salt.alias("salt"), F.col("c").alias("ca"))
        copies = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = _side(copies, "b", "key", "band", "salt", F.col("c").alias("cb"))
        return left.join(right, ["key", "band", "salt"]).where("a < b and ca != cb")

    def _fetch(self, texts: DataFrame, pool: DataFrame) -> DataFrame:
        """The full shingle sets of the documents in these pairs."""
        ids = materialize(pool.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        kind = texts.schema["id"].dataType.simpleString()
        return materialize(texts.join(small(ids), "id", "left_semi").mapInArrow(_sets(self.shingle), f"id {kind}, set array<long>").where(F.size("set") > 0), "sets")

    def _verify(self, pool: DataFrame, sets: DataFrame, links: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        """Links that connect the pool's documents as all its links would, and the pairs tested for them."""
        tested = None
        for width in WIDTHS:
            rest = pool
            if links is not None:
                # stars of the components found so far say the same as the links, and contract at once
                links = materialize(components(links).where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")), "comp")
                for side in ("a", "b"):
                    rest = rest.join(links.select(F.col("b").alias(side), F.col("a").alias(f"c{side}")), side, "left")
                rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "m")
            if tested is not None:
                rest = rest.join(tested, ["a", "b"], "left_anti")
            if width is not None:
                order = Window.partitionBy("b").orderBy(F.desc("m"), "a")
                rest = rest.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= width)
            pick = materialize(rest.select("a", "b"), "pick")
            if pick.isEmpty():
                break
            both = pick.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            common = F.size(F.array_intersect("sa", "sb"))
            linked = both.where(100 * common >= self.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()
            new = materialize(linked, "links")
            links = new if links is None else links.unionByName(new)
            tested = pick if tested is None else tested.unionByName(pick)
        return links, tested


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """See :class:`NearDuplicates`."""
    return NearDuplicates(**options).run(docs)


def miss_probability(similarity: float) -> float:
    """Chance that two sets of this similarity share no band."""
    return math.pow(1 - similarity**ROWS, BANDS)
