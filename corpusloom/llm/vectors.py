"""Most similar vectors for every vector: a block matrix join on int8 tiles.

Method.  Copies of a vector are folded into one class.  Every class vector is
hashed into cells by cross-polytope codes of random rotations (several tables);
within a cell the vectors form blocks, and every pair of blocks is one int8
product tile with exact integer sums.  A tile gives each cosine with a bound on
its quantisation error; pairs whose upper bound reaches the threshold, and one
of whose ends doesn't already have k better ones for certain (a heap of lower
bounds a row), survive.  Survivors are recomputed in double from the float
vectors, and the k best of each vector are merged.

Accuracy loss: a pair is missed only if it shares no cell in any table.  The
number of tables is set so that the recall of the k best pairs stays near 0.99
whatever the cell size (measured in tests/llm/test_joins.py).  ``exact`` does
all tiles instead, and misses nothing.

Defined results: null, all-zero, too short vectors and vectors with null or
non-finite numbers take no part; rows repeated under one key count once; a
table without usable vectors gives an empty result; columns other than those
named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import shuffle_partitions

#: (dimensions of the further hashes; number of tables).  Finer cells need more tables for the same recall.
LEVELS = (((), 6), ((2,), 9), ((8,), 12), ((32,), 16), ((32, 4), 24), ((32, 32), 36))
CELL_ROWS = 8192  # wanted rows of a cell; decides the level
TILE = 1024  # rows of a block in a product tile
HOT_ROWS = 32_768  # cells above this are spread over several tasks
SIFT = 2_000_000  # pairs held before they are sifted
HOT_BROADCAST = 500_000  # hot cells that may be broadcast (12 bytes each)
SEED = 20240229


def level_for(rows: int) -> tuple[tuple[int, ...], int]:
    """The coarsest cells that hold about CELL_ROWS rows each, for vectors of 64 numbers; the finest beyond."""
    return next((x for x in LEVELS if rows / (128 * math.prod(2 * n for n in x[0])) <= CELL_ROWS), LEVELS[-1])


@lru_cache(maxsize=64)
def _rotation(dim: int, table: int, part: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim, table, part])
    return np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)


def _polytope(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    y = x @ rotation
    k = np.abs(y).argmax(axis=1)
    return (2 * k + (y[np.arange(len(y)), k] > 0)).astype(np.int64)


def cells(x: np.ndarray, table: int, further: tuple[int, ...]) -> np.ndarray:
    """The cell of each row of x in one table."""
    dim = x.shape[1]
    out = _polytope(x, _rotation(dim, table, 0))
    for part, n in enumerate(further, 1):
        out = out * (2 * min(n, dim)) + _polytope(x, _rotation(dim, table, part)[:, : min(n, dim)])
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, the scale of each row and a bound on ||row - scale * codes||."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(x - codes * scale[:, None], axis=1) * 1.0001 + 1e-6
    return codes, scale.astype(np.float32), rest.astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, ids, unit vectors) of each dimension in a batch."""
    vec = batch.column("vec")
    sizes = np.asarray(pa.compute.list_value_length(vec))
    ids = batch.column("cid").to_numpy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, ids[at], _unit(_matrix(vec.take(pa.array(at))))


def hashed(classes: DataFrame, further: tuple[int, ...], tables: int) -> DataFrame:
    """One row a class and table: space, tab, cell, and the packed int8 vector; all in one cell of their space without tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = batch.column("space")
            for at, ids, x in _chunks(batch):
                codes, scale, rest = quantise(x)
                packed = np.concatenate([ids[:, None].view(np.int8), scale[:, None].view(np.int8), rest[:, None].view(np.int8), codes], axis=1)
                width = packed.shape[1]
                offsets = pa.py_buffer((np.arange(len(ids) + 1) * width).astype(np.int32).tobytes())
                rows = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(np.ascontiguousarray(packed).tobytes())])
                for t in range(max(1, tables)):
                    cell = cells(x, t, further) if tables else np.zeros(len(ids), np.int64)
                    yield pa.RecordBatch.from_arrays([space.take(pa.array(at)), pa.array(np.full(len(ids), t, np.int32)), pa.array(cell), rows], ["space", "tab", "cell", "row"])

    return classes.select("cid", "space", "vec").mapInArrow(work, "space long, tab int, cell long, row binary")


def _unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scales, bounds of the rest, int8 codes)."""
    data = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1)
    ids = np.ascontiguousarray(data[:, :8]).view(np.int64)[:, 0]
    scale = np.ascontiguousarray(data[:, 8:12]).view(np.float32)[:, 0]
    rest = np.ascontiguousarray(data[:, 12:16]).view(np.float32)[:, 0]
    return ids, scale, rest, data[:, 16:]


EXACT_DIMS = 1024  # numbers whose products of int8 codes add up exactly in float32 (below 2 ** 24)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer products of two blocks of int8 codes (held as float32): each partial sum is a whole number below 2 ** 24, and so exact in the fast product."""
    out = a[:, :EXACT_DIMS] @ b[:, :EXACT_DIMS].T
    for k in range(EXACT_DIMS, a.shape[1], EXACT_DIMS):
        out = out.astype(np.float64) + a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T
    return out


def _bound(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """Bound on the error of a product of two quantised unit rows, float32 rounding included."""
    return a * (1 + b) + b + 2e-5


class Heaps:
    """For every row a binary heap of the k largest values pushed, the least of them at its root."""

    def __init__(self, n: int, k: int):
        self.values = np.full((n, k), -2.0, np.float32)

    def root(self) -> np.ndarray:
        return self.values[:, 0]

    def push(self, who: np.ndarray, value: np.ndarray) -> None:
        """Push many values; a row's go in one after another, its largest first, those of different rows at once."""
        keep = value > self.values[who, 0]
        who, value = who[keep], value[keep]
        if not len(who):
            return
        order = np.lexsort((-value, who))
        who, value = who[order], value[order]
        first = np.r_[True, who[1:] != who[:-1]]
        turn = np.arange(len(who)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        for t in range(min(self.values.shape[1], int(turn.max()) + 1)):
            at = np.flatnonzero(turn == t)
            at = at[value[at] > self.values[who[at], 0]]
            self.values[who[at], 0] = value[at]
            self._sift(who[at])

    def _sift(self, rows: np.ndarray) -> None:
        """Let new roots sink."""
        k = self.values.shape[1]
        at = np.zeros(len(rows), np.int64)
        while len(rows):
            left, right = 2 * at + 1, 2 * at + 2
            go = left < k
            rows, at, left, right = rows[go], at[go], left[go], right[go]
            child = np.where((right < k) & (self.values[rows, np.minimum(right, k - 1)] < self.values[rows, left]), right, left)
            go = self.values[rows, child] < self.values[rows, at]
            rows, at, child = rows[go], at[go], child[go]
            self.values[rows, at], self.values[rows, child] = self.values[rows, child], self.values[rows, at]
            at = child


class Survivors:
    """The pairs that may still count, by heaps of the k best lower bounds a row."""

    def __init__(self, n: int, k: int, least: float):
        self.heaps, self.least = Heaps(n, k), least
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.sift_at = 0, SIFT

    def tile(self, a: slice, b: slice, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        """The int8 product of block a with block b.

        One bound for the whole tile leaves few pairs; those get their own.
        """
        dots = products(codes[a], codes[b])
        worst = _bound(rest[a].max(), rest[b].max())
        dots *= scale[b][None, :]
        near = dots >= ((self.least - worst) / scale[a])[:, None]
        if a == b:
            near = np.triu(near, 1)
        at = np.flatnonzero(near)
        if not len(at):
            return
        i, j = np.divmod(at, near.shape[1])
        value, size = dots[i, j] * scale[a][i], _bound(rest[a][i], rest[b][j])
        keep = value + size >= self.least
        i, j, value, size = i[keep] + a.start, j[keep] + b.start, value[keep], size[keep]
        self.heaps.push(i, (value - size).astype(np.float32))
        self.heaps.push(j, (value - size).astype(np.float32))
        self._add(i, j, value + size)

    def _add(self, i: np.ndarray, j: np.ndarray, upper: np.ndarray) -> None:
        """Keep pairs that may still count; the floors only rise, so earlier pairs are sifted again now and then."""
        floor = self.heaps.root()
        keep = (upper >= floor[i]) | (upper >= floor[j])
        self.pairs.append((i[keep], j[keep], upper[keep]))
        self.held += int(keep.sum())
        if self.held > self.sift_at:
            i, j, upper = (np.concatenate(x) for x in zip(*self.pairs))
            keep = (upper >= floor[i]) | (upper >= floor[j])
            self.pairs = [(i[keep], j[keep], upper[keep])]
            self.held = int(keep.sum())
            self.sift_at = max(SIFT, 2 * self.held)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j, up = (np.concatenate(x) for x in zip(*self.pairs))
        floor = self.heaps.root()
        keep = (up >= floor[i]) | (up >= floor[j])
        return i[keep], j[keep]


def _join_blocks(rows: list[bytes], part: np.ndarray | None, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Survivors of a cell, or of the pair of parts of a hot cell (part: 0 or 1 a row)."""
    ids, scale, rest, x = _unpack(rows)
    x = x.astype(np.float32)
    if part is not None:
        order = np.argsort(part, kind="stable")
        ids, scale, rest, x = ids[order], scale[order], rest[order], x[order]
    n, cut_at = len(ids), int((part == 0).sum()) if part is not None else 0
    found = Survivors(n, k, least)
    blocks = [slice(s, min(s + TILE, end)) for begin, end in (((0, n),) if part is None else ((0, cut_at), (cut_at, n))) for s in range(begin, end, TILE)]
    for n_a, a in enumerate(blocks):
        for b in blocks[n_a:]:
            if part is None or (a.start < cut_at <= b.start):
                found.tile(a, b, x, scale, rest)
    i, j = found.left()
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def candidate_pairs(classes: DataFrame, rows: int, k: int, least: float, exact: bool = False) -> DataFrame:
    """Distinct pairs (a < b) of class ids that may be among the k best and reach ``least``; with exact all of them."""
    spark = classes.sparkSession
    further, tables = ((), 0) if exact else level_for(rows)
    index = hashed(classes, further, tables)
    place = ["space", "tab", "cell"]
    sizes = index.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > HOT_ROWS).select(*place, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts"))
    if rows * max(1, tables) / HOT_ROWS <= HOT_BROADCAST:  # so many hot cells there are at most
        hot = F.broadcast(hot)
    # A hot cell's rows go to every pair of parts that holds theirs; other cells are one group.
    placed = (
        index.join(hot, place, "left")
        .withColumn("own", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        .select(
            *place,
            F.when(F.col("other") < 0, -1).otherwise(F.least("own", "other")).alias("p"),
            F.when(F.col("other") < 0, -1).otherwise(F.greatest("own", "other")).alias("q"),
            F.when(F.col("other") < 0, -1).otherwise(F.col("own")).alias("own"),
            "row",
        )
    )
    groups = max(shuffle_partitions(spark), int(rows * max(1, tables) / 60_000) + 1)
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64(*place, "p", "q"), F.lit(groups)).cast("int"))

    def work(keys: tuple, data: pa.Table) -> pa.Table:
        keyed = [data.column(x).to_numpy() for x in ("q", "p", "cell", "tab", "space")]
        q, p, own = keyed[0], keyed[1], data.column("own").to_numpy()
        rows_ = data.column("row").combine_chunks() if data.num_rows else data.column("row")
        order = np.lexsort(keyed)
        edge = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in keyed], axis=0), True])
        out_a, out_b = [], []
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s < 2:
                continue
            at = order[s:e]
            split = None
            if p[at[0]] != q[at[0]]:
                split = (own[at] == q[at[0]]).astype(np.int8)
            a, b = _join_blocks(rows_.take(pa.array(at)).to_pylist(), split, k, least)
            out_a.append(a)
            out_b.append(b)
        none = np.zeros(0, np.int64)
        a, b = np.concatenate(out_a or [none]), np.concatenate(out_b or [none])
        pairs = pd.DataFrame({"a": a, "b": b}).drop_duplicates()
        return pa.table({"a": pa.array(pairs["a"].to_numpy(), pa.int64()), "b": pa.array(pairs["b"].to_numpy(), pa.int64())})

    return bucketed.groupBy("bucket").applyInArrow(work, "a long, b long").distinct()


def exact_cosines(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Cosine of each pair, in double and rounded to 6 decimals."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("vec").alias(f"v{x}"), F.col("model").alias(f"m{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter((F.col("ma") == F.col("mb")) & (F.size("va") == F.size("vb")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("va")))
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                x, y = (_matrix(batch.column(c).take(at)).astype(np.float64) for c in ("va", "vb"))
                x /= np.abs(x).max(axis=1, keepdims=True)
                y /= np.abs(y).max(axis=1, keepdims=True)
                cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(np.round(np.clip(cos, -1, 1), 6))], ["a", "b", "cosine"])

    return both.select("a", "b", "va", "vb").mapInArrow(work, "a long, b long, cosine double")


def usable(df: DataFrame, dim: str = "dim") -> DataFrame:
    """Rows whose vec is complete: right length, finite, not all zero."""
    ok = (
        F.col("vec").isNotNull()
        & (F.size("vec") == F.col(dim))
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3.0e38))
        & F.exists("vec", lambda x: x != 0)
    )
    return df.filter(ok)


def named_classes(good: DataFrame) -> DataFrame:
    """good with cid, the class of equal model and numbers.

    cid is a 64-bit hash; where two different classes have the same (a second
    hash tells), all but one take another.
    """
    both = good.withColumn("cid", F.xxhash64("model", "vec")).withColumn("second", F.xxhash64(F.lit(SEED), "vec", "model"))
    clash = both.groupBy("cid").agg(F.min("second").alias("first_one"), F.max("second").alias("last_one")).filter("first_one <> last_one").select("cid", "first_one")
    # n rows have about n * n / 2 ** 65 clashes: a handful in ten billion
    other = F.col("first_one").isNotNull() & (F.col("second") != F.col("first_one"))
    return both.join(F.broadcast(clash), "cid", "left").withColumn("cid", F.when(other, F.xxhash64("cid", "second")).otherwise(F.col("cid"))).drop("second", "first_one")


def nearest(df: DataFrame, k: int = 5, least: float = 0.85, rows: int | None = None, exact: bool = False) -> DataFrame:
    """The up to k nearest of each key among those of its model: (key, other, cosine, rank).

    df: key string, model string, dim int, vec array<float>; keys must be
    unique except for exact copies of a row.  Cosines below ``least`` don't
    count; ties go to the smaller key (by code point).  ``rows``: an estimate
    of the number of rows (it decides the cell size only); counted if None.
    ``exact``: all tiles, quadratic in the rows.
    """
    rows = df.count() if rows is None else rows
    good = usable(df).select("key", "model", F.col("vec").cast("array<float>").alias("vec"))
    named = named_classes(good)
    classes = named.groupBy("cid").agg(F.first("vec").alias("vec"), F.first("model").alias("model")).withColumn("space", F.xxhash64("model", F.size("vec")))
    members = named.select("cid", "key").distinct()
    pairs = candidate_pairs(classes, rows, k, least, exact)
    near = exact_cosines(pairs, classes).filter(F.col("cosine") >= least)
    edges = near.select("a", "b", "cosine").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))

    # The k + 1 smallest keys of a class stand for it: no vector takes more of one class.  Partial aggregation keeps only k + 1 keys a task.
    firsts = _smallest_keys(members, k + 1)
    ranked = (
        edges.join(firsts.withColumnRenamed("cid", "b"), "b")
        .withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), F.element_at("keys", 1))))
        .filter(F.col("r") <= k)
    )
    others = ranked.groupBy("a").agg(F.collect_list(F.struct("cosine", "keys")).alias("near"))
    own = firsts.filter(F.size("keys") > 1)
    offers = own.withColumnRenamed("keys", "own").join(others.withColumnRenamed("a", "cid"), "cid", "full_outer")
    listed = F.concat(
        F.transform(F.coalesce("own", F.array().cast("array<string>")), lambda x: F.struct((-F.lit(1.0)).alias("c"), x.alias("key"))),
        F.flatten(
            F.transform(
                F.coalesce("near", F.array().cast("array<struct<cosine:double,keys:array<string>>>")),
                lambda n: F.transform(n["keys"], lambda x: F.struct((-n["cosine"]).alias("c"), x.alias("key"))),
            )
        ),
    )
    best = offers.select("cid", F.slice(F.array_sort(listed), 1, k + 1).alias("best"))
    return (
        members.join(best, "cid")
        .select("key", F.posexplode(F.slice(F.filter("best", lambda s: s["key"] != F.col("key")), 1, k)).alias("pos", "hit"))
        .select("key", F.col("hit.key").alias("other"), (-F.col("hit.c")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    )


def _smallest_keys(members: DataFrame, n: int) -> DataFrame:
    """The n smallest keys of each class, in two steps so that a class of copies never meets in one task."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(256)).cast("int"))
    w = Window.partitionBy("cid", "salt").orderBy("key")
    part = salted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return part.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("key")), 1, n).alias("keys"))
