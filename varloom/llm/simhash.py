"""Operator 6: near-duplicates by SimHash and BK-trees.

Fingerprints within ``radius`` bits of each other agree in at least three of six
bit blocks (radius 3), so each distinct fingerprint goes to the shard of every
three blocks: twenty keys of 31 to 33 bits.  A shard's fingerprints form a
BK-tree, whose children are keyed by their integer Hamming distance to the
parent, and a search follows only the edges within the radius.  The trees of all
shards of a block of rows are built and searched together, level by level.

Shard trees are not broadcast: together they are as large as the corpus, and the
block keys send each fingerprint to just the trees that can hold a neighbour.

Copies share a fingerprint and are one point of a tree; a shard gives a spanning
star of each of its components and never all pairs.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero, which links like any other; a text of fewer words than a
shingle has one shingle; a null id gets a row and never is a component's id,
unless all its members' ids are null (then null); repeated rows give repeated
results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, free_name, text_chunks, texts
from varloom.llm.components import Union, connected_components

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SEED = 42
RADIUS = 3
BLOCKS = 6
#: Pairs of a query and a node that one step of a search holds.
FRONTIER = 1 << 20
#: Points of a shard that one task searches, and points of all the shards of a task.
CROWD, TASK_ROWS = 2048, 1 << 22


def shingle_hashes(text: str, words_each: int) -> tuple[np.ndarray, bytes]:
    """Hashes of a text's shingles, repeats included, and a 128-bit name of its words."""
    from xxhash import xxh64_intdigest, xxh128_digest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, np.uint64), xxh128_digest(joined)
    n = len(words) - words_each + 1
    if n < 1:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64), xxh128_digest(joined)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[words_each - 1 :].tolist()
    return np.fromiter(map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(SEED)), np.uint64, n), xxh128_digest(joined)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; no hashes give zero."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words_each: int) -> int:
    return majority(shingle_hashes(text, words_each)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed 64-bit integer."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_chunks(whole):
                fps = np.array([fingerprint(t, words_each) for t in texts(b)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(radius: int = RADIUS) -> list[int]:
    """For each choice of blocks that two near fingerprints must share, its bits."""
    cuts = np.linspace(0, 64, BLOCKS + 1).astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, BLOCKS - radius)]


def search(group: np.ndarray, x: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, nodes and distances of all pairs within the radius in each group (rows
    sorted by group).  The BK-trees of all groups are built and searched at once."""
    n = len(x)
    first = np.r_[True, group[1:] != group[:-1]]
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    rest, at = np.flatnonzero(~first), root[~first]
    keys, kids = [], []
    while len(rest):
        key = at * 65 + np.bitwise_count(x[rest] ^ x[at])
        unique, where, back = np.unique(key, return_index=True, return_inverse=True)
        child = rest[where]
        keys.append(unique)
        kids.append(child)
        later = np.ones(len(rest), dtype=bool)
        later[where] = False
        rest, at = rest[later], child[back][later]
    if not keys:
        return
    key, kid = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(key)
    key, kid = key[order], kid[order]
    sizes = np.diff(np.r_[np.flatnonzero(first), n])
    asks = np.repeat(sizes > 1, sizes)
    # The stack holds parts of the frontier of all searches, so memory stays bounded.
    stack = [(q, root[q]) for q in np.array_split(np.flatnonzero(asks), max(1, asks.sum() // (FRONTIER // 4)))]
    while stack:
        q, node = stack.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            stack += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = np.bitwise_count(x[q] ^ x[node]).astype(np.int64)
        hit = (d <= radius) & (q != node)
        yield q[hit], node[hit], d[hit]
        low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), side="left")
        high = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), side="right")
        count = high - low
        total = int(count.sum())
        if total:
            start = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
            stack.append((np.repeat(q, count), kid[start + np.arange(total)]))


def near_in_groups(group: np.ndarray, x: np.ndarray, radius: int) -> np.ndarray:
    """Labels of components within each group."""
    union = Union(len(x))
    for q, node, _ in search(group, x, radius):
        union.link(q, node)
    return union.label


def in_shards(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """``solve`` over whole shards, many at a time, of rows sorted by their first
    column; shards of one row are left out."""

    def whole(columns: list[np.ndarray]) -> pa.RecordBatch:
        shard = columns[0]
        same = shard[1:] == shard[:-1]
        kept = np.r_[same, False] | np.r_[False, same]
        return solve(*(c[kept] for c in columns))

    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size > 1 << 18:
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last shard may go on
            if cut:
                yield whole([c[:cut] for c in columns])
            held, size = [[c[cut:] for c in columns]], len(columns[0]) - cut
    if size:
        yield whole([np.concatenate(c) for c in zip(*held)])


def links(scratch: Scratch, points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a``, ``b`` between near fingerprints, enough to connect all that are
    connected.  ``points``: distinct ``fp``."""
    masks = block_masks(radius)
    keyed = points.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))).alias("mask", "bits"))
    keyed = keyed.select(F.xxhash64("mask", "bits").alias("shard"), "fp")

    def solve(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label = near_in_groups(shard, fp.view(np.uint64), radius) if len(fp) else np.zeros(0, np.int64)
        moved = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["a", "b"])

    # A crowded shard is cut into parts, and a task holds two of them at most: each part
    # goes with every other, so all its fingerprints still meet.
    counts = keyed.groupBy("shard").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1")
    counts = scratch.table(counts.select(F.col("shard").alias("of"), "parts"), "crowded")
    cut = keyed.join(counts, keyed.shard == counts.of, "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # A part meets itself when it meets the next one, so pairs of equal numbers are left out.
    cut = cut.where("parts IS NULL OR own <> other")
    group = F.when(F.col("parts").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")))
    n = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() * len(masks) // TASK_ROWS))
    dealt = cut.select(group.alias("shard"), "fp").repartition(n, "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(lambda batches: in_shards(batches, solve), "a long, b long").distinct()


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = RADIUS) -> DataFrame:
    """``id_col``, ``fp`` and ``component`` (the smallest id linked, its own included)."""
    scratch = Scratch(df.sparkSession, "simhash")
    table = scratch.table(fingerprints(df, id_col, text_col, words_each), "fp")
    points = scratch.table(table.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "points")
    edges = scratch.table(links(scratch, points.select("fp"), radius), "links")
    nodes = scratch.table(connected_components(scratch, edges), "nodes")
    rooted = nodes.join(points, nodes.node == points.fp).select("root", "node", "rep")
    least = scratch.table(rooted.groupBy("root").agg(F.min("rep").alias("component")), "least")
    of_linked = nodes.join(least, "root").select(F.col("node").alias("fp"), "component")
    # Fingerprints of one document without links need no lookup.
    alone = points.where("n > 1").join(nodes, points.fp == nodes.node, "left_anti").select("fp", F.col("rep").alias("component"))
    lookup = scratch.table(of_linked.unionByName(alone), "lookup").select(F.col("fp").alias("of"), F.col("component"))
    joined = table.join(lookup, table.fp == lookup.of, "left")
    return joined.select(F.col("id").alias(id_col), "fp", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    return cluster(df, id_col, text_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# --- near copies by similarity -------------------------------------------------

#: Minima of a text's shingles, and how many of them make a shard's key.
MINIMA, EACH = 64, 4
#: Fingerprint bits that texts of similarity 0.8 may differ in: about nine are
#: expected of 64, and the spread is three.
LOOSE_RADIUS = 18
#: Rows of a group that one task compares at first, and of a side in pairs of chunks;
#: shingles of either; and rows of a large group that meet all its chunks.
CHUNK, WIDE, HASHES, HUBS = 128, 512, 1 << 20, 64


def minima_keys(distinct: np.ndarray) -> np.ndarray:
    """Keys of the shards that a text's shingle set belongs to: texts of similarity 0.8
    share one of them almost surely.  One permutation is cut into ``MINIMA`` bins; an
    empty bin borrows from the next full one."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    mixed = distinct * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    bins = (mixed & np.uint64(MINIMA - 1)).astype(np.int64)
    low = np.full(MINIMA, np.iinfo(np.uint64).max)
    np.minimum.at(low, bins, mixed)
    full = np.flatnonzero(low != np.iinfo(np.uint64).max)
    take = full[np.searchsorted(full, np.arange(MINIMA)) % len(full)]
    gap = (take - np.arange(MINIMA)) % MINIMA
    low = low[take] + gap.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key = np.zeros(MINIMA // EACH, np.uint64)
    for column in low.reshape(-1, EACH).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return ((key >> np.uint64(6) << np.uint64(6)) | np.arange(MINIMA // EACH, dtype=np.uint64)).view(np.int64)


def signatures(df: DataFrame, row_col: str, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """``row``, ``id``, ``copy`` (a name of the words), ``fp`` (of distinct shingles) and ``keys``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_chunks(whole, 2):
                fps, copies, keys = [], [], []
                for text in texts(b, 2):
                    h, name = shingle_hashes(text, words_each)
                    distinct = np.unique(h)
                    fps.append(majority(distinct))
                    copies.append(name)
                    keys.append(minima_keys(distinct))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(copies, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    names=["row", "id", "copy", "fp", "keys"],
                )

    return df.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, copy binary, fp long, keys array<long>")


def candidates(scratch: Scratch, points: DataFrame, radius: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect every two rows within the radius in some shard's
    BK-tree, so that all pairs to compare lie within components.  ``points``: ``row``,
    ``fp``, ``keys``.  The rows of a shard of more than ``CROWD``, such as a large group
    of near copies, are connected whole, without a tree."""

    def solve(shard: np.ndarray, row: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label = near_in_groups(shard, fp.view(np.uint64), radius) if len(row) else np.zeros(0, np.int64)
        moved = label != np.arange(len(row))
        return pa.RecordBatch.from_arrays([pa.array(row[moved]), pa.array(row[label[moved]])], names=["a", "b"])

    keyed = scratch.table(points.select(F.explode("keys").alias("shard"), "row", "fp"), "keyed")
    crowded = keyed.groupBy("shard").agg(F.count("*").alias("rows"), F.min("row").alias("least")).where(F.col("rows") > CROWD)
    crowded = scratch.table(crowded.select(F.col("shard").alias("of"), "least"), "crowded")
    joined = keyed.join(crowded, keyed.shard == crowded.of, "left")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.where("least IS NULL").select("shard", "row", "fp").repartition(n, "shard").sortWithinPartitions("shard", "row")
    whole = joined.where("least IS NOT NULL AND row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    return dealt.mapInArrow(lambda batches: in_shards(batches, solve), "a long, b long").unionByName(whole).distinct()


def shingle_sets(df: DataFrame, words_each: int) -> DataFrame:
    """``row``, ``group``, ``n`` and ``set``, the hashes of a text's distinct shingles.
    ``df``: ``row``, ``group``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_chunks(whole, 2):
                found = [np.unique(shingle_hashes(t, words_each)[0]) for t in texts(b, 2)]
                columns = [b.column(0), b.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "group", "n", "set"])

    return df.select("row", "group", "text").mapInArrow(run, "row long, group long, n long, set binary")


def links_of(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a row of ``left`` and one of ``right`` that reach the similarity, enough to
    connect all that do; rows of one label are connected already."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.unique(label, return_inverse=True)[1]
    mark = np.zeros(len(names), np.int64)
    out = []
    for i in np.flatnonzero(left):
        other = right & (label != label[i]) & (size >= similarity * size[i] - 1e-6) & (size[i] >= similarity * size - 1e-6)
        if right[i]:
            other[:i] &= ~left[:i]  # met before
        other = np.flatnonzero(other)
        if not len(other):
            continue
        mine = code[start[i] : start[i] + size[i]]
        mark[mine] = 1
        before = np.cumsum(size[other]) - size[other]
        at = np.repeat(start[other] - before, size[other])
        shared = np.add.reduceat(mark[code[at + np.arange(len(at))]], before)
        mark[mine] = 0
        hits = other[shared / (size[i] + size[other] - shared) >= similarity - 1e-12]
        met, first = np.unique(label[hits], return_index=True)
        out += [(i, j) for j in hits[first]]
        if len(met):
            label[np.isin(label, met)] = label[i]
    return out


def judged(dealt: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` and their ``group`` from comparing, for each (``group``, ``lo``,
    ``hi``), the rows of ``left`` with those of ``right`` by their whole ``set``s."""
    names = ["group", "lo", "hi"]

    def solve(held: list[pa.RecordBatch]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        row, label, left, right = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (3, 4, 5, 6))
        if len(row) < 2:
            return row, []
        sets = [np.frombuffer(x, "<u8") for b in held for x in b.column(7).to_pylist()]
        return row, links_of(sets, label, left, right, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = [], None, []

        def close() -> None:
            row, links = solve(held)
            out.extend((row[i], row[j], last[0]) for i, j in links)

        def edges() -> pa.RecordBatch:
            a, b, group = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, group)], names=["a", "b", "group"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for x, y in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                key = tuple(int(m[x]) for m in marks)
                if held and key != last:
                    close()
                    held = []
                held.append(batch.slice(x, y - x))
                last = key
            yield edges()
            out = []
        if held:
            close()
        yield edges()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*names, "row", "label", "left", "right", "set").repartition(n, *names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "a long, b long, group long")


def alike(scratch: Scratch, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` that connect the rows of a group whose sets reach the similarity.

    A group too large for one task is compared in chunks; then all its rows with a few of
    those that linked most, as an original does its copies; and at last, by pairs of chunks,
    whatever is not connected with the largest component so far with all rows.  The second
    round only spares work of the third, which leaves no pair out."""
    yes, no = F.lit(True), F.lit(False)
    chunks_of = lambda rows, n, most: F.ceil(F.greatest(rows / most, n / HASHES)).cast("int")
    totals = sets.groupBy("group").agg(chunks_of(F.count("*"), F.sum("n"), CHUNK).alias("chunks"))
    crowded = scratch.table(totals.where("chunks > 1").select(F.col("group").alias("of"), "chunks"), "crowded")
    cut = sets.join(crowded, sets.group == crowded.of, "left").drop("of").withColumn("lo", F.pmod(F.xxhash64("row"), F.coalesce("chunks", F.lit(1))).cast("int"))
    first = scratch.table(judged(cut.withColumns({"hi": F.col("lo"), "label": F.col("row"), "left": yes, "right": yes}), similarity), "first")
    if crowded.isEmpty():
        return first.select("a", "b")
    large = scratch.table(cut.where("chunks IS NOT NULL"), "large")

    def unfinished(edges: DataFrame) -> DataFrame:
        """Rows, with labels, of the groups that are not one component yet."""
        nodes = scratch.table(connected_components(scratch, edges.join(crowded, edges.group == crowded.of, "left_semi").select("a", "b")), "nodes")
        state = large.drop("set").join(nodes, large.row == nodes.node, "left").select("row", "group", "n", "chunks", "lo", F.coalesce("root", "row").alias("label"))
        state = scratch.table(state, "state")
        left = state.groupBy(F.col("group").alias("of")).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("of")
        return scratch.table(state.join(left, state.group == left.of, "left_semi"), "unfinished")

    with_sets = lambda rows: rows.hint("merge").join(large.select("row", "set"), "row")
    state = unfinished(first)
    degree = first.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count("*").alias("links"))
    ranked = state.join(degree, state.row == degree.of, "left").withColumn("turn", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(HUBS)))
    hubs = ranked.groupBy("group", "turn").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "row", "label", "chunks")).alias("h"))
    hubs = with_sets(hubs.select("group", "h.row", "h.label", "h.chunks")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["group", "lo", F.col("lo").alias("hi"), "row", "label", "left", "right", "set"]
    met = with_sets(state).withColumns({"left": no, "right": yes}).select(*columns).unionByName(hubs.withColumns({"left": yes, "right": no}).select(*columns))
    second = scratch.table(first.unionByName(judged(met, similarity)), "second")

    state = unfinished(second)
    parts = state.groupBy("group", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    every = parts.groupBy("group").agg(F.max(F.struct("rows", "n", "label")).alias("m"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    plan = every.select(F.col("group").alias("of"), F.col("m.label").alias("main"), chunks_of(F.col("rows") - F.col("m.rows"), F.col("n") - F.col("m.n"), WIDE).alias("rest"), chunks_of(F.col("m.rows"), F.col("m.n"), WIDE).alias("mains"))
    plan = scratch.table(plan, "plan")
    placed = state.join(plan, state.group == plan.of).withColumn("inside", F.col("label") == F.col("main"))
    own = F.when(F.col("inside"), F.col("rest") + F.pmod(F.xxhash64("row"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("row"), F.col("rest"))).cast("int")
    last = F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    placed = with_sets(placed.withColumn("own", own).withColumn("last", last)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    placed = placed.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    third = judged(placed.withColumns({"left": F.col("own") == F.col("lo"), "right": F.col("own") == F.col("hi")}), similarity)
    return second.unionByName(third).select("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, similarity: float = 0.8, radius: int = LOOSE_RADIUS) -> DataFrame:
    """One row of each group of near copies, that of smallest id (rows without an id
    come last; ties: one of them).  All columns stay.

    Near copies are texts whose sets of word shingles are alike by ``similarity`` at
    least; a radius of a few bits finds only the closest of them, and one that finds
    all does not let blocks of bits choose the shards.  So shards are chosen by minima
    of the shingles, a BK-tree over the fingerprints of each connects what lies within a
    loose radius, and within what is so connected every two texts are compared by their
    whole shingle sets, unless others connect them.  Texts of equal words are one point.

    Null and empty texts are one group (they have equal words: none); texts shorter than a
    shingle are alike only if their words are equal; a null id is kept where its group has
    no other; columns of any name stay, those of the operator's own working names too.
    """
    scratch = Scratch(df.sparkSession, "keep")
    own = free_name(df, "row")
    marked = scratch.table(df.select("*", F.monotonically_increasing_id().alias(own)), "rows")
    signed = scratch.table(signatures(marked, own, id_col, text_col, words_each), "signatures")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    copies = scratch.table(signed.groupBy("copy").agg(F.min("row").alias("rep"), best), "copies")
    reps = copies.select(F.col("rep").alias("row"))
    points = signed.select("row", "fp", "keys").hint("merge").join(reps, "row", "left_semi")
    pairs = scratch.table(candidates(scratch, points, radius), "pairs")
    scratch.drop(signed)
    groups = scratch.table(connected_components(scratch, pairs).select(F.col("node").alias("of"), F.col("root").alias("group")), "groups")
    scratch.drop(pairs)
    # By sorting: both sides grow with the corpus.
    bare = marked.select(F.col(own).alias("row"), F.col(text_col).alias("text"))
    grouped = bare.hint("merge").join(groups, bare.row == groups.of).drop("of")
    sets = scratch.table(shingle_sets(grouped, words_each), "sets")
    edges = scratch.table(alike(scratch, sets, similarity), "edges")
    scratch.drop(sets)
    nodes = connected_components(scratch, edges)
    rooted = copies.join(nodes, copies.rep == nodes.node, "left").select(F.coalesce("root", "rep").alias("root"), "best")
    chosen = scratch.table(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(own)), "chosen")
    for done in (groups, copies, edges):  # what is left to read are the rows and the choice
        scratch.drop(done)
    return marked.hint("merge").join(chosen, own, "left_semi").select(*(f"`{c}`" for c in df.columns))
