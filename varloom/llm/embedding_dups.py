"""Operator 7: near-duplicate embeddings by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits by a random direction at the
median of its sample.  Every vector goes down every tree, to both sides where its
projection lies close to a split (spill), so near vectors share a leaf in some tree
with high probability.  Vectors of equal label within a leaf are compared by blocks
of a matrix product in double precision, and links are united.

Equal vectors of a label are one point with a multiplicity.  A leaf gives counts and
a spanning star, never pairs: a pair that shares several leaves is counted in the
first of them, which each row can tell as it carries the leaves of all trees.

The first trees' sample is of fixed size, so their leaves grow with the table.  A leaf of
more than ``CHUNK`` points of a label is split again by a tree fitted on a sample of its
own rows, and so on until leaves are small or no split thins them out, so work grows
with the table and not its square.  A leaf that stays crowded (a dense group) is dealt by pairs
of chunks, so all its pairs are still compared and no task holds it whole.

Defined results: null labels, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of different lengths do not link;
rows that repeat an id are vectors of their own; a null id gets a row and never is a
component's id unless all its members' are null; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch
from varloom.llm.components import Union, connected_components

CHUNK = 4096
BLOCK = 1024
#: Rows, about, that a crowded leaf's tree is fitted on, and how often leaves are split
#: again at most; what then is crowded still is compared whole.
OWN_SAMPLE = 4096
LEVELS = 8
#: A split pays if both sides together make fewer pairs, so sides hold less than 0.7.
LARGEST_SIDE = 0.7
TRIES = 3


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    trees: int = 4
    #: Most vectors the trees are fitted on (those of smallest hash), and the rows a
    #: leaf should hold; leaves are not split below eight vectors of the sample.
    sample: int = 32_768
    leaf_rows: int = 512
    #: Half width of the spill, in deviations of a just-linked pair's projections.
    spill: float = 0.8
    seed: int = 17

    def margin(self, width: int) -> float:
        return self.spill * float(np.sqrt(2 * (1 - self.threshold) / width))


class Tree:
    """Nodes are (draw, cut, left, right), the first is the root, and leaves are ~number.  A
    node's direction is the draw of that number from the tree's seed, so a tree packs small."""

    def __init__(self, width: int, margin: float, seed: tuple[int, ...], nodes: list[tuple[int, float, int, int]] | None = None):
        self.width, self.margin, self.seed = width, margin, seed
        self.nodes = nodes or []
        self.leaves = 0
        self.draws = 0
        self.directions: dict[int, np.ndarray] = {}

    @classmethod
    def grown(cls, x: np.ndarray, leaf: int, margin: float, seed: tuple[int, ...]) -> Tree:
        tree = cls(x.shape[1], margin, seed)
        tree._grow(x, leaf, 0)
        return tree

    def packed(self) -> bytes:
        return np.array(self.nodes, dtype=np.float64).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, width: int, margin: float, seed: tuple[int, ...]) -> Tree:
        rows = np.frombuffer(data, dtype=np.float64).reshape(-1, 4)
        return cls(width, margin, seed, [(int(d), float(c), int(a), int(b)) for d, c, a, b in rows])

    def _direction(self, draw: int) -> np.ndarray:
        if draw not in self.directions:
            d = np.random.default_rng((*self.seed, draw)).normal(size=self.width)
            self.directions[draw] = d / np.linalg.norm(d)
        return self.directions[draw]

    def _split(self, x: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray] | None:
        """The first of some directions along which a split pays."""
        for _ in range(TRIES):
            self.draws += 1
            p = x @ self._direction(self.draws)
            cut = float(np.median(p))
            left, right = p < cut + self.margin, p >= cut - self.margin
            if max(left.sum(), right.sum()) < LARGEST_SIDE * len(x):
                return self.draws, cut, left, right
            del self.directions[self.draws]
        return None

    def _grow(self, x: np.ndarray, leaf: int, depth: int) -> int:
        found = self._split(x) if len(x) > leaf and depth <= 40 else None
        if found is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        draw, cut, left, right = found
        at = len(self.nodes)
        self.nodes.append((draw, cut, 0, 0))
        self.nodes[at] = (draw, cut, self._grow(x[left], leaf, depth + 1), self._grow(x[right], leaf, depth + 1))
        return at

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves, a pair for each leaf that a row reaches."""
        rows, found = [], []
        stack = [(0 if self.nodes else ~0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                rows.append(at)
                found.append(np.full(len(at), ~node))
            elif len(at):
                draw, cut, a, b = self.nodes[node]
                p = x[at] @ self._direction(draw)
                stack += [(a, at[p < cut + self.margin]), (b, at[p >= cut - self.margin])]
        return np.concatenate(rows), np.concatenate(found)


class Forest:
    """Trees for vectors of one length; ``cells`` numbers the leaves of all trees."""

    def __init__(self, x: np.ndarray, rows: int, s: Settings):
        leaf = max(8, int(s.leaf_rows * len(x) / max(1, rows)))
        self.trees = [Tree.grown(x, leaf, s.margin(x.shape[1]), (s.seed, t)) for t in range(s.trees)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, found, base = [], [], 0
        for t in self.trees:
            r, c = t.leaves_of(x)
            rows.append(r)
            found.append(c + base)
            base += t.leaves
        return np.concatenate(rows), np.concatenate(found)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def points(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows with ``ok``: whether the vector takes part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.col(label_col).isNotNull() & F.coalesce(whole, F.lit(False))
    return df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), ok.alias("ok"))


def compare(cell: int, first: np.ndarray, second: np.ndarray | None, rows: dict[str, np.ndarray], s: Settings, out: dict) -> None:
    """Count and unite the links within ``first``, or between ``first`` and ``second``."""
    other = first if second is None else second
    x, cells, times = rows["x"], rows["cells"], rows["times"]
    for a in range(0, len(first), BLOCK):
        left = first[a : a + BLOCK]
        for b in range(a if second is None else 0, len(other), BLOCK):
            right = other[b : b + BLOCK]
            i, j = np.nonzero(x[left] @ x[right].T >= s.threshold)
            i, j = left[i], right[j]
            if second is None:
                up = i < j
                i, j = i[up], j[up]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                shared = (cells[p][:, :, None] == cells[q][:, None, :]).any(axis=2)
                lowest = np.where(shared & (cells[p] >= 0), cells[p], np.iinfo(np.int64).max).min(axis=1)
                own = lowest == cell
                np.add.at(out["links"], p[own], times[q[own]])
                np.add.at(out["links"], q[own], times[p[own]])
                out["union"].link(p, q)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values by row, rising."""
    order = np.lexsort((values, rows))
    counts = np.bincount(rows, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values[order].astype(np.int64)))


def _fitting(level: int, s: Settings):
    def fit(key: tuple, t: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        x = unit(_vectors(t.column("v").combine_chunks()))[np.argsort(t.column("rid").to_numpy())]
        rows = t.column("rows")[0].as_py()
        small = max(8, int(s.leaf_rows * len(x) / rows))
        tree = Tree.grown(x, small, s.margin(x.shape[1]), (s.seed, level, leaf))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "rows": pa.array([rows], pa.int64()), "model": pa.array([tree.packed()], pa.binary())})

    return fit


def _descending(level: int, s: Settings):
    def descend(key: tuple, t: pa.Table, model: pa.Table) -> pa.Table:
        if not t.num_rows or not model.num_rows:
            return pa.table({"rid": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "leaves": pa.array([], pa.list_(pa.int64()))})
        x = unit(_vectors(t.column("v").combine_chunks()))
        tree = Tree.unpacked(model.column("model")[0].as_py(), x.shape[1], s.margin(x.shape[1]), (s.seed, level, key[0].as_py()))
        return pa.table({"rid": t.column("rid"), "cell": t.column("cell"), "leaves": _lists(*tree.leaves_of(x), len(x))})

    return descend


def refine(scratch: Scratch, placed: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``placed`` (rid, label, v, times, cells) with crowded leaves split by trees of their own,
    and the leaves (label, n, cell, rows) that stay crowded.

    A tree is fitted in one task on about ``OWN_SAMPLE`` rows of its leaf and then meets the
    leaf's rows by parts of about ``CHUNK``, so no task holds a leaf.
    """
    keys = ["label", "n", "cell"]
    stuck = None
    for level in range(1, LEVELS + 2):
        in_cells = placed.select("rid", "label", F.size("v").alias("n"), "v", F.explode("cells").alias("cell"))
        sizes = in_cells.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > CHUNK)
        if stuck is not None:
            sizes = sizes.join(stuck, keys, "left_anti")
        crowded = scratch.table(sizes.withColumn("leaf", F.monotonically_increasing_id()), "crowded")
        known = crowded.select(*keys, "rows")
        if level > LEVELS or crowded.isEmpty():
            break
        held = in_cells.join(crowded, keys).select("leaf", "rid", "cell", "rows", "v")
        some = held.where(F.pmod(F.xxhash64(F.lit(level), "rid"), F.col("rows")) < OWN_SAMPLE)
        models = scratch.table(some.groupBy("leaf").applyInArrow(_fitting(level, s), "leaf long, rows long, model binary"), "models")
        split = models.where(F.length("model") > 0)
        if split.isEmpty():
            break
        useless = crowded.join(models.where(F.length("model") == 0).select("leaf"), "leaf", "left_semi").select(*keys, "rows")
        stuck = useless if stuck is None else stuck.unionByName(useless)
        parts = F.ceil(F.col("rows") / CHUNK).cast("int")
        rows = held.join(split.select("leaf"), "leaf", "left_semi").withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int"))
        trees = split.select(F.col("leaf").alias("of"), "model", F.explode(F.sequence(F.lit(0), parts - 1)).alias("place"))
        moved = rows.groupBy("leaf", "part").cogroup(trees.groupBy("of", "place")).applyInArrow(_descending(level, s), "rid long, cell long, leaves array<bigint>")
        # Two leaves of one number would only be compared together.
        number = lambda k: F.xxhash64(F.lit(level), F.col("cell"), k).bitwiseAND(F.lit((1 << 62) - 1))
        moved = moved.select("rid", "cell", F.transform("leaves", number).alias("leaves"))
        new = moved.groupBy("rid").agg(F.collect_list("cell").alias("gone"), F.flatten(F.collect_list("leaves")).alias("more"))
        cells = F.array_distinct(F.concat(F.array_except("cells", "gone"), "more"))
        finer = placed.join(new, "rid", "left").select("rid", "label", "v", "times", F.when(F.col("gone").isNull(), F.col("cells")).otherwise(cells).alias("cells"))
        finer = scratch.table(finer, "placed")
        scratch.drop(placed)
        placed = finer
    return placed, known if stuck is None else stuck.unionByName(known)


def find(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", s: Settings = Settings()) -> DataFrame:
    """Per vector ``id_col``, ``n_links``, ``component_id`` and ``kept``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embeddings")
    every = scratch.table(points(df, id_col, vector_col, label_col), "rows")
    usable = every.where("ok")
    unique = usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    unique = scratch.table(unique.withColumn("rid", F.monotonically_increasing_id()), "unique")
    lengths = unique.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").collect()  # a row for each vector length
    forests: dict[int, Forest] = {}
    for row in lengths:
        some = unique.where(F.size("v") == row.n).orderBy(F.xxhash64("v", "label"), "rid").limit(s.sample).select("v").toArrow().column("v").combine_chunks()
        forests[row.n] = Forest(unit(_vectors(some)), row.rows, s)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                rows, cells = forests[int(n)].cells(unit(_vectors(part.column(2))))
                lists = _lists(rows, cells, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "cells"])

    label = unique.schema["label"].dataType.simpleString()
    placed = unique.select("rid", "label", "v", "times").mapInArrow(place, f"rid long, label {label}, v array<double>, times long, cells array<bigint>")
    placed, crowded = refine(scratch, scratch.table(placed, "placed"), s)
    crowded = crowded.select(F.col("label").alias("l"), F.col("n").alias("m"), F.col("cell").alias("c"), F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    in_cells = placed.select("rid", "label", "v", "times", "cells", F.size("v").alias("n"), F.explode("cells").alias("cell"))
    in_cells = in_cells.join(crowded, (F.col("label") == F.col("l")) & (F.col("n") == F.col("m")) & (F.col("cell") == F.col("c")), "left")
    chunks = F.coalesce("chunks", F.lit(1))
    mine = in_cells.withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    key = F.xxhash64("label", "n", "cell", F.least("chunk", "other"), F.greatest("chunk", "other"))
    dealt = mine.select(key.alias("group"), "label", "n", "cell", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "rid", "times", "v", "cells")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["label", "n", "cell", "lo", "hi"]
    dealt = dealt.repartition(parts, *names).sortWithinPartitions(*names)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        col = {name: t.column(i) for i, name in enumerate(t.schema.names)}
        lists = col["cells"]
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        cells = np.full((t.num_rows, int(counts.max())), -1, dtype=np.int64)
        cells[np.arange(cells.shape[1])[None] < counts[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        rows = {"cells": cells, "times": col["times"].to_numpy(zero_copy_only=False)}
        marks = [col[k].to_numpy(zero_copy_only=False) for k in ("group", "n", "cell", "lo", "hi")]
        new = np.r_[True, np.any([m[1:] != m[:-1] for m in marks], axis=0)] if t.num_rows else np.zeros(0, bool)
        starts = np.r_[np.flatnonzero(new), t.num_rows]
        out = {"links": np.zeros(t.num_rows, dtype=np.int64), "union": Union(t.num_rows)}
        _, n, cell, lo, hi = marks
        chunk = col["chunk"].to_numpy(zero_copy_only=False)
        for a, b in zip(starts, starts[1:]):
            if b - a < 2:
                continue
            x = unit(_vectors(col["v"].slice(a, b - a)))
            here = rows | {"x": x, "cells": cells[a:b], "times": rows["times"][a:b]}
            sub = {"links": out["links"][a:b], "union": Union(b - a)}
            at = np.arange(b - a)
            if lo[a] == hi[a]:
                compare(int(cell[a]), at, None, here, s, sub)
            else:
                low = chunk[a:b] == lo[a]
                compare(int(cell[a]), at[low], at[~low], here, s, sub)
            out["union"].label[a:b] = sub["union"].label + a
        rid = col["rid"].to_numpy(zero_copy_only=False)
        keep = (out["links"] > 0) | (out["union"].label != np.arange(t.num_rows))
        return pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array(out["links"][keep]), pa.array(rid[out["union"].label[keep]])], names=["rid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("group", "n", "cell", "lo", "hi")]
            new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            key = tuple(m[0] for m in marks)
            cut = 0 if key != last else (int(new[0]) if len(new) else None)
            if cut is not None and held and (size + cut >= 16_384 or key != last and size >= 16_384):
                if cut:
                    held.append(batch.slice(0, cut))
                yield solve(held)
                held, size = [], 0
                batch = batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            last = tuple(m[-1] for m in marks)
        if held:
            yield solve(held)

    found = scratch.table(dealt.mapInArrow(run, "rid long, links long, root long"), "links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    nodes = scratch.table(connected_components(scratch, found.select(F.col("rid").alias("a"), F.col("root").alias("b"))), "nodes")
    rep = unique.select("rid", "rep")
    rooted = nodes.join(rep, nodes.node == rep.rid).select("root", "node", "rep")
    least = scratch.table(rooted.groupBy("root").agg(F.min("rep").alias("component")), "least")
    of_node = nodes.join(least, "root").select(F.col("node").alias("rid"), "component")
    known = unique.select("rid", "label", "v", "rep", "times").join(counts, "rid", "left").join(of_node, "rid", "left")
    known = known.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = scratch.table(known.where((F.col("n_links") > 0)), "known")
    joined = every.select("id", "label", "v", "ok").join(known, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    out = joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
