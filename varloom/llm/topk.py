"""Operator 8: exact top-k search by columnar branch and bound.

Candidates are dealt to shards; a task holds one shard, in vertical layout (one row of
the matrix per dimension), and streams all queries past it in blocks.  Inner products
are accumulated a block of dimensions at a time.  After each block the lengths of what
remains of a query and of a candidate bound what the product can still gain or lose;
candidates whose upper bound lies below a query's k-th lower bound go, and the
surviving columns are compacted for the next block.

A first pass gives every query the k-th best score of a small sample of candidates, so
that pruning begins with the first column of each shard.  Every shard is searched whole.

Bounds are rounded outwards and survivors are scored in exact integers.  Vectors with a
scaled component of 2 ** 24 or more are not bounded at all but scored in integers of any
length.

Defined results: vectors that are null, or hold null or non-finite components, take
no part; a null id can be found (after all other ids of its score); vectors of another
length than the query's are no candidates of it; rows that repeat an id are queries and
candidates of their own, only a query's own row is none; ties go to the smaller id; a
score beyond a long is given as the long's end; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import Scratch

SCALE = 256
#: Components from here on, and vectors longer than this, are scored without bounds.
NARROW, MOST_DIMS = float(1 << 24), 1 << 14
#: Queries of a block, candidates of a step, values of a shard and of the sample, and
#: dimensions between prunings.
QUERY_BLOCK = 512
STEP = 4096
SHARD_VALUES = 1 << 20
SAMPLE_VALUES = 1 << 16
DIMS = 16
LONG = np.iinfo(np.int64)
#: Stands for a missing id, and for an empty place.
NO_ID = int(LONG.max)


def usable(df: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """``row`` (its own name), ``id``, ``asks`` and ``v`` (doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(whole, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v"))


class Block:
    """Vectors of one length: rows, ids, the matrix (a row per dimension) of scaled
    components, and for the narrow ones the lengths of what remains from each block on."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.row, self.id, self.raw = row, ids, values
        with np.errstate(over="ignore"):
            scaled = np.floor(values * SCALE)
        self.narrow = (np.abs(scaled) < NARROW).all(axis=1) & (values.shape[1] <= MOST_DIMS)
        self.vertical = np.ascontiguousarray(np.where(self.narrow[:, None], scaled, 0.0).T)
        self.rest = rest_lengths(self.vertical)

    def __len__(self) -> int:
        return len(self.row)

    def part(self, a: int, b: int) -> Block:
        return Block(self.row[a:b], self.id[a:b], self.raw[a:b])

    def integers(self, k: int) -> list[int]:
        """A vector's scaled components, whatever their size."""
        return [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in self.raw[k].tolist()]


class Best:
    """The k highest scores of each query so far, ties to the smaller id, then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LONG.min)
        self.id = np.full((queries, k), NO_ID)
        self.row = np.full((queries, k), -1)

    def add(self, q: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        s, i, r = np.r_[self.score[q], scores], np.r_[self.id[q], ids], np.r_[self.row[q], rows]
        # empty places come last; a long's complement turns its order round without overflow
        top = np.lexsort((r, i, ~s, r < 0))[: self.k]
        self.score[q], self.id[q], self.row[q] = s[top], i[top], r[top]

    def floor(self, q: int) -> float:
        """No score below this can enter."""
        return float(self.score[q, -1]) if self.row[q, -1] >= 0 else -np.inf


def rest_lengths(vertical: np.ndarray) -> np.ndarray:
    """For each block start, the length of each column from there on, rounded up."""
    squares = vertical**2
    tails = np.cumsum(squares[::-1], axis=0)[::-1]
    starts = list(range(0, len(vertical), DIMS))
    out = np.vstack([tails[s] for s in starts] + [np.zeros(vertical.shape[1])]) if starts else np.zeros((1, vertical.shape[1]))
    return np.sqrt(out) * (1 + 1e-9) + 1e-6


def exact(q: Block, j: int, c: Block, cols: np.ndarray) -> np.ndarray:
    """Scores of a query with some candidates; longs hold those of narrow vectors."""
    out = np.empty(len(cols), np.int64)
    easy = c.narrow[cols] if q.narrow[j] else np.zeros(len(cols), bool)
    out[easy] = q.vertical[:, j].astype(np.int64) @ c.vertical[:, cols[easy]].astype(np.int64)
    if not easy.all():
        mine = q.integers(j)
        sums = [sum(a * b for a, b in zip(mine, c.integers(k))) for k in cols[~easy].tolist()]
        out[~easy] = [min(max(s, int(LONG.min)), int(LONG.max)) for s in sums]
    return out


def search(best: Best, floors: np.ndarray, q: Block, c: Block) -> None:
    """Add candidates to the best of each query, whose k-th score is not below its floor."""
    dims = len(c.vertical)
    products = q.vertical[:DIMS].T @ c.vertical[:DIMS]
    for j in range(len(q)):
        other = c.row != q.row[j]
        unbounded = np.flatnonzero(other & ~c.narrow) if q.narrow[j] else np.flatnonzero(other)
        if len(unbounded):
            best.add(j, c.row[unbounded], c.id[unbounded], exact(q, j, c, unbounded))
        if not q.narrow[j]:
            continue
        least = max(best.floor(j), floors[j])
        blur = 1e-12 * q.rest[0, j] * c.rest[0]  # what sums of doubles may be off by
        cols = np.flatnonzero(other & c.narrow)
        partial, at, block = products[j][cols], min(DIMS, dims), 1
        while len(cols):
            slack = q.rest[min(block, len(q.rest) - 1), j] * c.rest[min(block, len(c.rest) - 1), cols] + blur[cols]
            if len(cols) > best.k:
                least = max(least, np.partition(partial - slack, -best.k)[-best.k])
            stay = partial + slack >= least - 1.0 - 1e-12 * abs(least)
            cols, partial = cols[stay], partial[stay]
            if at >= dims or not len(cols):
                break
            end = min(at + DIMS, dims)
            partial = partial + q.vertical[at:end, j] @ c.vertical[at:end][:, cols]
            at, block = end, block + 1
        if len(cols):
            best.add(j, c.row[cols], c.id[cols], exact(q, j, c, cols))


def blocks_of(row: np.ndarray, ids: np.ndarray, vectors: pa.Array, *more: np.ndarray) -> list[tuple]:
    """Vectors as one ``Block`` for each length, with the matching parts of ``more``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == n)
        values = flat[starts[some][:, None] + np.arange(n)] if n else np.zeros((len(some), 1))
        out.append((n, Block(row[some], ids[some], values), *(m[some] for m in more)))
    return out


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("row").to_numpy(), b.column("id").fill_null(NO_ID).to_numpy()


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``df`` that ``is_query`` its ``k`` highest integer inner products with
    all other rows: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    data = scratch.table(usable(df, is_query, id_col, vector_col), "data")
    size = data.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0)).alias("values"), F.coalesce(F.max(F.size("v") + 1), F.lit(1)).alias("widest")).first()
    batch_rows = max(16, min(2000, (1 << 18) // size.widest))

    # Floors from a sample that SAMPLE_VALUES bounds; it goes to the tasks with their code.
    sample_rows = max(1, SAMPLE_VALUES // size.widest)
    sample = data.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("row", "id", "v").toArrow().combine_chunks().to_batches()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: c for b in sample for n, c in blocks_of(*_columns(b), b.column("v"))}
        for b in batches:
            floors = np.full(b.num_rows, -np.inf)
            row, ids = _columns(b)
            for n, q, where in blocks_of(row, ids, b.column("v"), np.arange(b.num_rows)):
                if n in known:
                    best = Best(len(q), k)
                    search(best, np.full(len(q), -np.inf), q, known[n])
                    floors[where] = [best.floor(j) for j in range(len(q))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("v"), pa.array(floors)], names=["row", "id", "v", "floor"])

    asked = data.where("asks").select("row", "id", "v").mapInArrow(first, "row long, id long, v array<double>, floor double")
    asked = scratch.table(asked, "queries", batch_rows)

    shards = max(1, -(-size["values"] // SHARD_VALUES), min(-(-size.rows // 1024), spark.sparkContext.defaultParallelism))
    dealt = data.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "row", "id", "v", F.lit(0.0).alias("floor"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    met = dealt.unionByName(asked.select(every.alias("shard"), F.lit(True).alias("asks"), "row", "id", "v", "floor"))
    met = met.repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, built = None, None
        for whole in batches:
            marks, asks = whole.column("shard").to_numpy(), whole.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                if a == z:
                    continue
                b = whole.slice(a, z - a)
                if marks[a] != shard:
                    shard, held, built = marks[a], [], None
                if not asks[a]:
                    held.append(b)
                    continue
                if built is None:  # candidates come before queries
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()
                    built = {n: [c.part(i, i + STEP) for i in range(0, len(c), STEP)] for t in table for n, c in blocks_of(*_columns(t), t.column("v"))}
                    held = []
                for i in range(0, b.num_rows, QUERY_BLOCK):
                    some = b.slice(i, QUERY_BLOCK)
                    for n, q, floors in blocks_of(*_columns(some), some.column("v"), some.column("floor").to_numpy()):
                        best = Best(len(q), k)
                        for c in built.get(n, ()):
                            search(best, floors, q, c)
                        which, slot = np.nonzero(best.row >= 0)
                        ids = best.id[which, slot]
                        found = [pa.array(q.row[which]), pa.array(q.id[which]), pa.array(best.row[which, slot]), pa.array(ids, mask=ids == NO_ID), pa.array(best.score[which, slot])]
                        yield pa.RecordBatch.from_arrays(found, names=["asker", "query_id", "row", "vec_id", "score"])

    found = scratch.table(met.mapInArrow(run, "asker long, query_id long, row long, vec_id long, score long"), "found", batch_rows)
    scratch.drop_named("data", "queries")
    w = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
