"""Operator 4: removal of repeated passages by sparse distributed prefix doubling.

Sampled places of the texts are ranked by longer and longer strings, 16 bytes, 32 and
the threshold of 50.  In each round Spark sorts pairs of the rank so far and the name
of the bytes at the next offset, with the place; a pass over the sorted rows gives
equal pairs their new rank, and places whose rank no other document has leave.

Only a locally consistent sample of places is ranked at first (the rightmost least hash
of the ``GRAM``-byte strings in each window of ``LENGTH`` bytes): equal windows choose
the same place, their anchor, so neighbouring windows are judged together at theirs.

1. 16 bytes: anchors are sorted by the name of their gram.
2. The run: pairs of that rank and the name of all bytes that the windows of an anchor
   hold.  Where a smaller document has the pair, all these windows are repeated; where
   none has, the pair's rank stands for the run.
3. 32 bytes: pairs of the gram's rank and the 16 bytes before or after it, one side a
   row.  A side stays if different runs share it: a passage begins or ends there.
4. 50 bytes: the single windows of a side, pairs of its rank and the name of the rest.

A sorted part is read as a stream.  Parts are cut by the document too, so the rows of a
hot rank divide among them; ranks that reach a part's edge, or have more rows than a
worker holds, are closed by an aggregate over their rows.  A rank is the part's number
and a count inside it, so no pass is needed to number them.  Texts meet what is known of them in a sort-merge join, a
document a row.  Parts are sized from counted rows.

Names are 64 bits, and every decision is taken on a rank and a name together.

Defined results: a null or empty text has 0 bytes and the hash of nothing; texts shorter
than ``LENGTH`` bytes keep everything; a null id is larger than any other, and never
equals one; rows that repeat an id do not remove each other's bytes; texts are judged
whole, as given; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, byte_buffer, text_chunks

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1  # grams of a window
#: Windows that begin at least so far before their anchor hold the whole gram before it;
#: all others hold the whole gram after it.
LEFT_FROM = LENGTH - 2 * GRAM - 1
NO_ID = int(np.iinfo(np.int64).max)
U = np.uint64
#: Bytes of text that are hashed at a time, few enough for a processor's own memory.
TEXT_BYTES = 1 << 15
#: Rows of a part, rows that go to or from Python at a time, and rows of one rank that it holds.
PART_ROWS, SORTED_ROWS, HELD = 1 << 21, 1 << 16, 1 << 17


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def grams(data: np.ndarray) -> np.ndarray:
    """The 64-bit name of the ``GRAM`` bytes from each position."""
    b = data.astype(np.uint64)
    x2 = b[:-1] | (b[1:] << U(8))
    x4 = x2[:-2] | (x2[2:] << U(16))
    x8 = x4[:-4] | (x4[4:] << U(32))
    n = len(data) - GRAM + 1
    h = mixed(x8[:n] * U(0x9E3779B97F4A7C15) + U(1))
    return mixed((h ^ x8[8 : 8 + n]) * U(0xBF58476D1CE4E5B9))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position: whether a window starts there (within its document) and
    where that window's anchor is; and the gram names."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(data)
    low = (h >> U(32) << U(32)) | (U(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w = 1
    while 2 * w <= WINDOW:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if w < WINDOW:
        low = np.minimum(low[: -(WINDOW - w)], low[WINDOW - w :])
    at = (U(0xFFFFFFFF) - (low & U(0xFFFFFFFF))).astype(np.int64)
    ok = np.ones(n, dtype=bool)
    for end in offsets[1:].tolist():
        ok[max(0, end - LENGTH + 1) : end] = False
    return ok, at, h


def runs(ok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a buffer, ascending, the first window of each and how many it has."""
    start = np.flatnonzero(ok)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[start[1:]] != at[start[:-1]]) | (np.diff(start) > 1)
    first = np.flatnonzero(new)
    return at[start[first]], start[first], np.diff(np.r_[first, len(start)])


def chained(*names: np.ndarray) -> np.ndarray:
    """One name for a sequence of names."""
    out = np.full(len(names[0]), U(0x27D4EB2F165667C5))
    for k, name in enumerate(names):
        out = mixed((out ^ name) * U(0x9E3779B97F4A7C15) + U(2 * k + 1))
    return out


def run_names(h: np.ndarray, anchor: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Names of all bytes that the windows of each run hold, and of the anchor's place in them."""
    end = start + count - 1 + LENGTH - GRAM
    pieces = [h[np.minimum(start + k, end)] for k in range(0, LENGTH + WINDOW - GRAM, GRAM)]
    return chained(*pieces, h[end], (count << 8 | anchor - start).astype(np.uint64))


def window_names(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    return chained(*(h[start + k] for k in range(0, LENGTH - GRAM, GRAM)), h[start + LENGTH - GRAM])


# A place is a long: the anchor's byte, how far before it the first window begins (8 bits),
# and how many windows there are (8 bits).
def place(anchor: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
    return anchor << 16 | before << 8 | count


def unplaced(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 16, p >> 8 & 0xFF, p & 0xFF


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def rerank(scratch: Scratch, rows: DataFrame, n: int, keys: list[str], owner: str, keep: str, name: str) -> DataFrame:
    """Sort ``rows`` (columns of type long, from written tables) by ``keys``, the first of
    which is a name, in ``n`` parts, and give rows of equal keys one ``rank``; ``smaller``
    says whether a smaller owner has the same rank.  ``keep``: ``all`` rows, those with a
    ``smaller`` owner, or those of ``several``, ranks that more than one owner has.  Of
    ``all`` rows, those with a smaller owner may keep only id, mark and place."""
    columns = rows.columns
    where = [columns.index(k) for k in keys]
    own = columns.index(owner)
    asked = [k for k, c in enumerate(columns) if c in ("id", "mark", "place")]
    schema = ", ".join([f"{c} long" for c in columns] + ["rank long", "smaller boolean", "edge boolean"])

    def by_keys(values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows in the order of all keys, and where a new combination begins."""
        for turn in range(2):
            new = np.zeros(len(values[0]), bool)
            for k in where:
                new[1:] |= values[k][1:] != values[k][:-1]
            if turn or not (new[1:] & (values[where[0]][1:] == values[where[0]][:-1])).any():
                break
            order = np.lexsort([values[k] for k in where[::-1]])  # a name that several strings have
            values = [v[order] for v in values]
        new[:1] = True
        return values, np.flatnonzero(new)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []
        edge = True  # the part's first name may have begun in the part before

        def ranked(values: list[np.ndarray], edge: bool) -> pa.RecordBatch:
            nonlocal rank
            values, starts = by_keys(values)
            sizes = np.diff(np.r_[starts, len(values[0])])
            ranks = rank + np.repeat(np.arange(len(sizes)), sizes)
            rank += len(sizes)
            least = np.minimum.reduceat(values[own], starts)
            smaller = values[own] > np.repeat(least, sizes)
            if not edge and keep != "all":
                some = smaller if keep == "smaller" else np.repeat(np.maximum.reduceat(values[own], starts) != least, sizes)
                values, ranks, smaller = [v[some] for v in values], ranks[some], smaller[some]
            done = smaller if keep == "all" and not edge else None  # nothing but the place of these is asked for
            out = [pa.array(v, mask=done if k not in asked else None) for k, v in enumerate(values)]
            return pa.RecordBatch.from_arrays([*out, pa.array(ranks), pa.array(smaller), pa.array(np.full(len(ranks), edge))], names=[*columns, "rank", "smaller", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            values = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held:
                values = [np.concatenate(c) for c in zip(held, values)]
            name = values[where[0]]
            last = int(np.searchsorted(name, name[-1], side="left"))
            first = int(np.searchsorted(name, name[0], side="right")) if edge else 0
            if edge:
                yield ranked([v[:first] for v in values], True)
                edge = first == len(name)
            if first < last:
                yield ranked([v[first:last] for v in values], False)
            held = [v[max(first, last) :] for v in values]
            if len(held[0]) > HELD:
                yield ranked(held, True)
                edge = True
            if edge:
                held = []
        if held:
            yield ranked(held, True)

    # Hot ranks, and rows that are wholly alike, divide among parts; inside one the names
    # are all that Spark has to sort by.
    salted = rows.withColumn("_part", F.spark_partition_id())
    dealt = salted.repartitionByRange(n, *keys, owner, "_part").drop("_part").sortWithinPartitions(keys[0])
    streamed = scratch.table(dealt.mapInArrow(stream, schema), name, SORTED_ROWS)
    totals = streamed.where("edge").groupBy(*keys).agg(F.min(owner).alias("_least"), F.max(owner).alias("_most"), F.min("rank").alias("_rank"))
    totals = scratch.table(totals.select(*(F.col(k).alias(f"_{k}") for k in keys), "_least", "_most", "_rank", F.lit(True).alias("_edge")), f"{name}-edges")
    met = streamed.join(totals, [F.col(k) == F.col(f"_{k}") for k in [*keys, "edge"]], "left")
    smaller = F.when(F.col("edge"), F.col(owner) > F.col("_least")).otherwise(F.col("smaller"))
    kept = {"all": F.lit(True), "smaller": smaller, "several": ~F.col("edge") | (F.col("_least") != F.col("_most"))}[keep]
    return met.where(kept).select(*columns, F.coalesce("_rank", "rank").alias("rank"), smaller.alias("smaller"))


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _told(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which row each told thing belongs to, and the fields of all."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), [_longs(f) for f in values.flatten()]


def _rows(names: list[str], *values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64, copy=False)) for v in values], names=names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


def _each(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (key, raw, ...) with their bytes and offsets."""
    for whole in batches:
        for b in text_chunks(whole, len(key), TEXT_BYTES):
            yield b, *byte_buffer(b, len(key))


def gathered(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of columns of longs, small pieces put together."""
    held, size = [], 0
    for piece in rows:
        held.append(piece)
        size += len(piece[0])
        if size >= SORTED_ROWS:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _batch(pieces: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*pieces)]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)) for c in columns], names=names)


def _keys(b: pa.RecordBatch, key: list[str], doc: np.ndarray) -> list[np.ndarray]:
    return [_longs(b.column(k))[doc] for k in range(len(key))]


def first(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of a document's anchors, once each."""

    def rows() -> Iterator[list[np.ndarray]]:
        for b, data, offsets in _each(batches, key):
            ok, at, h = anchors(data, offsets)
            found, _, _ = runs(ok, at)
            doc = np.searchsorted(offsets, found, side="right") - 1
            _, once = np.unique(in_document(h[found], doc), return_index=True)
            yield [h[found[once]], *_keys(b, key, doc[once])]

    return gathered(rows(), ["h", *key])


def in_document(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Names that differ between the documents of a batch."""
    return mixed(name ^ mixed(doc.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(5)))


def second(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the anchors whose gram other documents have."""

    def rows() -> Iterator[list[np.ndarray]]:
        for b, data, offsets in _each(batches, key):
            ok, at, h = anchors(data, offsets)
            anchor, start, count = runs(ok, at)
            doc = np.searchsorted(offsets, anchor, side="right") - 1
            of, (name, rank) = _told(b.column(len(key) + 1))
            known = in_document(name.view(np.uint64), of)
            order = np.argsort(known)
            known, rank = known[order], rank[order]
            asked = in_document(h[anchor], doc)
            spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = np.flatnonzero(known[spot] == asked)
            anchor, start, count, doc, rank = anchor[hit], start[hit], count[hit], doc[hit], rank[spot[hit]]
            # Names beside the gram; where a text has none, no window asks for them.
            sides = (h[np.maximum(anchor - GRAM, 0)] >> U(32) << U(32)) | (h[np.minimum(anchor + GRAM, len(h) - 1)] >> U(32))
            spots = place(anchor - offsets[doc], anchor - start, count)
            yield [rank, run_names(h, anchor, start, count), sides, *_keys(b, key, doc), spots]

    return gathered(rows(), ["gram", "run", "sides", *key, "place"])


def third(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of the sides that different runs share."""

    def rows() -> Iterator[list[np.ndarray]]:
        for b, data, offsets in _each(batches, key):
            of, (rank, spots, left) = _told(b.column(len(key) + 1))
            anchor, most, count = unplaced(spots)
            least = most - count + 1
            low = np.where(left == 1, np.maximum(least, LEFT_FROM), least)
            high = np.where(left == 1, most, np.minimum(most, LEFT_FROM - 1))
            sizes = np.maximum(high - low + 1, 0)
            each = np.repeat(np.arange(len(of)), sizes)
            before = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            doc = of[each]
            start = anchor[each] - before  # within the document
            h = grams(data) if len(data) >= LENGTH else np.zeros(0, np.uint64)
            name = chained(window_names(h, start + offsets[doc]), before.astype(np.uint64))
            yield [rank[each], name, *_keys(b, key, doc), place(start, np.zeros_like(start), np.ones_like(start))]

    return gathered(rows(), ["side", "window", *key, "place"])


def last(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document."""
    for b, data, offsets in _each(batches, key):
        of, (spots,) = _told(b.column(len(key) + 1))
        anchor, before, count = unplaced(spots)
        begin = anchor - before + offsets[of]
        cover = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + count - 1 + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = gone & np.r_[True, ~gone[:-1]][: len(gone)]
        sizes, removed, spans, kept = [], [], [], []
        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            mask = gone[x:y]
            sizes.append(y - x)
            removed.append(int(mask.sum()))
            # a run that begins with the document may follow another's end
            spans.append(int(edge[x + 1 : y].sum()) + int(y > x and mask[0]))
            kept.append(data[x:y][~mask].tobytes())
        ids = pc.if_else(pc.equal(b.column(0), NO_ID), None, b.column(0))
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def _sources(scratch: Scratch, df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``id`` and ``raw``, and the columns that name a text: the id, and where ids have several
    rows a mark that tells their texts apart (0, but for those ids the text's hash)."""
    bare = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    repeated = scratch.table(bare.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("c")).where("c > 1").select("of"), "repeated")
    if repeated.isEmpty():
        return bare, ["id"]
    mark = F.when(F.col("of").isNull(), F.lit(0)).otherwise(F.xxhash64("raw")).cast("long")
    return bare.join(repeated, bare.id == repeated.of, "left").select("id", mark.alias("mark"), "raw"), ["id", "mark"]


def _meet(docs: DataFrame, told: DataFrame, key: list[str], things: Column, n: int, how: str) -> DataFrame:
    """Documents with all that is told of each, dealt to ``n`` parts."""
    by_doc = told.repartition(n, *key).groupBy(*key).agg(F.collect_list(things).alias("told"))
    return docs.repartition(n, *key).hint("merge").join(by_doc, key, how).select(*key, "raw", "told")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining
    bytes, which may not be whole characters)."""
    return _removed(Scratch(df.sparkSession, "substrings"), df, id_col, text_col)


def _removed(scratch: Scratch, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    docs, key = _sources(scratch, df, id_col, text_col)

    # 16 bytes
    sampled = scratch.table(docs.mapInArrow(partial(first, key), _schema(["h", *key])), "anchors")
    n = parts_for(sampled.count())
    shared = rerank(scratch, sampled, n, ["h"], "id", "several", "grams")
    scratch.drop(sampled)

    # The run
    met = _meet(docs, shared, key, F.struct("h", "rank"), n, "inner")
    run_table = scratch.table(met.mapInArrow(partial(second, key), _schema(["gram", "run", "sides", *key, "place"])), "runs")
    scratch.drop_named("grams", "grams-edges")
    n_runs = parts_for(run_table.count())
    ranked = rerank(scratch, run_table, n_runs, ["run", "gram"], "id", "all", "ranks")
    scratch.drop(run_table)
    whole = ranked.where("smaller").select(*key, "place")

    # 32 bytes
    most, count = F.shiftright("place", 8).bitwiseAND(0xFF), F.col("place").bitwiseAND(0xFF)
    left = F.struct(F.lit(1).cast("long").alias("left"), F.shiftrightunsigned("sides", 32).alias("beside"))
    right = F.struct(F.lit(0).cast("long").alias("left"), F.col("sides").bitwiseAND(0xFFFFFFFF).alias("beside"))
    both = F.array_compact(F.array(F.when(most >= LEFT_FROM, left), F.when(most - count + 1 < LEFT_FROM, right)))
    open_runs = ranked.where("NOT smaller").select("gram", F.col("rank").alias("run"), *key, "place", F.explode(both).alias("s")).select("gram", "s.*", "run", *key, "place")
    side_rows = open_runs.select(F.xxhash64("gram", "left", "beside").alias("name"), "*")
    rims = rerank(scratch, side_rows, n_runs, ["name", "gram", "left", "beside"], "run", "several", "sides")

    # 50 bytes
    met = _meet(docs, rims, key, F.struct("rank", "place", "left"), n, "inner")
    windows = scratch.table(met.mapInArrow(partial(third, key), _schema(["side", "window", *key, "place"])), "windows")
    scratch.drop_named("sides", "sides-edges")
    single = rerank(scratch, windows, parts_for(windows.count()), ["window", "side"], "id", "smaller", "singles").select(*key, "place")
    scratch.drop(windows)

    met = _meet(docs, whole.unionByName(single), key, F.struct("place"), n, "left")
    out = met.mapInArrow(partial(last, key), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, written and read back (they are small), so that the last
    round runs with small batches too."""
    scratch = Scratch(df.sparkSession, "substrings")
    found = _removed(scratch, df, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    out = scratch.table(found, "digest")
    scratch.drop_named(*(set(scratch.held.values()) - {"digest"}))
    return out
