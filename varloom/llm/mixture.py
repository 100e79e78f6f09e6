"""Operator 2: mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled, form a tape of words that is cut into blocks of
equal numbers of words; a source that gives more than it has is read on from the
tape's start.  Golden-ratio points, mapped through the cumulative target shares, say
which source each slot of the mix takes, so every stretch of the mix has nearly the
target shares; ranking a source's slots says which block each takes.  A source's
last block is cut so that it gives its target to the word; slots that the points leave
it short of are added at the end, and those beyond it are dropped.

Ranks and tape places are running sums over two levels (chunks of about the square
root of a group), so a hot source is never one task's.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source
is a source of its own, last; repeated rows (equal ids too) are documents of their own;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, free_name, running_sums

#: Fixed value: the golden ratio's fractional part, (5 ** 0.5 - 1) / 2.
GOLDEN = 0.6180339887498949
#: Cells of [0, 1) by which points meet the sources' intervals.
CELLS = 4096


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block_words: int = 1024


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order: Column | None = None) -> DataFrame:
    """``id``, ``source``, ``size`` in words, and ``order``, by which tapes are shuffled (a
    hash of the id, unless given)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    order = F.xxhash64(F.col(id_col), F.lit(7)) if order is None else order
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order"))


def targets(sized: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per source: ``sid`` (from 0, by code point, null last), ``docs``,
    ``source_size`` and ``target``.

    Sources whose limit is reached are those of smallest limit per weight; with these
    set to their limits, the level of the others is what remains over their weights.
    The windows here hold one row for each source.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(w)) for w in s.weights))
    ranked = by_source.withColumn("sid", (F.row_number().over(order) - 1).cast("int"))
    ranked = ranked.withColumn("w", F.get(cycle, F.col("sid") % len(s.weights))).withColumn("limit", s.most * F.col("source_size"))
    ranked = ranked.withColumn("level", F.col("limit") / F.col("w"))
    rising = Window.orderBy("level", "sid")
    everything = Window.partitionBy()
    filled = ranked.withColumn("total", s.share * F.sum("source_size").over(everything))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    filled = filled.withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = filled.withColumn("water", (F.col("total") - F.col("capped")) / F.col("open"))
    # The first source whose limit lies at or above its water level sets the level for all.
    filled = filled.withColumn("found", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "sid", "water"))).over(everything))
    target = F.when(F.struct("level", "sid") < F.struct("found.level", "found.sid"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * F.col("found.water")))
    return filled.select("source", "sid", "docs", "source_size", F.coalesce(target, F.col("limit")).alias("target"))


def _chunk(order: Column, count: Column) -> Column:
    return F.pmod(order, F.ceil(F.sqrt(count)).cast("long")).cast("int")


def tape(scratch: Scratch, sized: DataFrame, source_table: DataFrame) -> DataFrame:
    """Documents on their source's tape: ``id``, ``sid``, ``size``, ``chunk`` and ``place``
    (which name the row), and ``start``, the words before it."""
    table = source_table.select(F.col("source").alias("of"), "sid", "docs")
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("of"))).select("id", "sid", "size", "order", _chunk(F.col("order"), F.col("docs")).alias("chunk"))
    rows = scratch.table(rows, "dealt")
    before = scratch.table(running_sums(rows, ["sid"], "chunk", F.col("size"), "before"), "before").select(F.col("sid").alias("s"), F.col("chunk").alias("c"), "before")
    w = Window.partitionBy("sid", "chunk").orderBy("order", "id", "size")
    inside = rows.withColumn("place", F.row_number().over(w)).withColumn("within", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return inside.join(before, (F.col("sid") == F.col("s")) & (F.col("chunk") == F.col("c"))).select("id", "sid", "size", "chunk", "place", (F.col("before") + F.col("within")).alias("start"))


def schedule(scratch: Scratch, source_table: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The mix: ``slot`` (its order), ``sid``, ``turn`` (from 0 within the source),
    ``lo`` and ``hi``, the words of the source's tape that it takes; ``hi`` may lie
    beyond the tape's end, which means its beginning."""
    spark = source_table.sparkSession
    goal = source_table.select("sid", "source_size", F.round("target").cast("long").alias("words")).where("words > 0")
    goal = goal.withColumn("turns", F.ceil(F.col("words") / s.block_words).cast("long"))
    shares = goal.withColumn("upto", F.sum("words").over(Window.orderBy("sid")) / F.sum("words").over(Window.partitionBy()))
    shares = shares.withColumn("from", F.coalesce(F.lag("upto").over(Window.orderBy("sid")), F.lit(0.0)))
    shares = scratch.table(shares, "shares")
    n = shares.agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("n")).first().n
    cells = shares.select("sid", "from", "upto", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("upto") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = spark.range(0, n, 1, parts).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    chunk = F.floor(F.col("slot") / max(1, int(n**0.5))).cast("int")
    drawn = points.join(cells, "cell").where((F.col("u") >= F.col("from")) & ((F.col("u") < F.col("upto")) | ((F.col("upto") >= 1.0) & (F.col("u") >= F.col("from"))))).select("slot", "sid", chunk.alias("chunk"))
    drawn = scratch.table(drawn, "drawn")
    before = scratch.table(running_sums(drawn, ["sid"], "chunk", F.lit(1), "before"), "ranks").select(F.col("sid").alias("s"), F.col("chunk").alias("c"), "before")
    w = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = drawn.withColumn("r", F.row_number().over(w)).join(before, (F.col("sid") == F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.select("slot", "sid", (F.col("before") + F.col("r") - 1).alias("turn"))
    got = drawn.groupBy("sid").agg(F.count("*").alias("got")).withColumnRenamed("sid", "s")
    short = shares.join(got, shares.sid == got.s, "left").where(F.coalesce("got", F.lit(0)) < F.col("turns"))
    added = short.select((F.lit(n) + F.col("sid")).alias("slot"), "sid", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("turns") - 1)).alias("turn"))
    limits = shares.select(F.col("sid").alias("s"), "words", "turns")
    every = ranked.unionByName(added).join(limits, F.col("sid") == F.col("s")).where("turn < turns")
    lo = F.col("turn") * s.block_words
    return every.select("slot", "sid", "turn", lo.alias("lo"), F.least(lo + s.block_words, F.col("words")).alias("hi"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", s: Settings = Settings(), order: Column | None = None) -> DataFrame:
    """Per document ``id_col``, ``size``, ``source_size``, ``target`` and ``taken``."""
    scratch = Scratch(df.sparkSession, "mixture")
    sized = scratch.table(sizes(df, id_col, text_col, source_col, order), "sizes")
    source_table = scratch.table(targets(sized, s), "sources")
    laid = scratch.table(tape(scratch, sized, source_table), "tape")
    lengths = source_table.select(F.col("sid").alias("s"), "source_size", "target")
    slots = scratch.table(schedule(scratch, source_table, s), "slots")
    # A slot is a stretch of one or more turns of the tape; as blocks of the tape itself
    # it is cut where a turn of the tape ends and at multiples of the block size.
    b = s.block_words
    size = F.col("source_size")
    turns = F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))
    cut = slots.join(lengths.select("s", "source_size"), F.col("sid") == F.col("s")).select("sid", "lo", "hi", "source_size", F.explode(turns).alias("k"))
    cut = cut.select("sid", (F.greatest("lo", F.col("k") * size) - F.col("k") * size).alias("lo"), (F.least("hi", (F.col("k") + 1) * size) - F.col("k") * size).alias("hi"))
    blocks = F.sequence(F.floor(F.col("lo") / b), F.floor((F.col("hi") - 1) / b))
    cut = cut.select("sid", "lo", "hi", F.explode(blocks).alias("block"))
    cut = cut.select("sid", "block", F.greatest("lo", F.col("block") * b).alias("lo"), F.least("hi", (F.col("block") + 1) * b).alias("hi"))
    spread = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))
    held = laid.where("size > 0").select("sid", "chunk", "place", "start", "size", F.explode(spread).alias("block"))
    cut = scratch.table(cut, "cuts").select(F.col("sid").alias("s"), F.col("block").alias("bl"), "lo", "hi")
    met = scratch.table(held, "blocks").join(cut, (F.col("sid") == F.col("s")) & (F.col("block") == F.col("bl")))
    words = F.greatest(F.lit(0), F.least("hi", F.col("start") + F.col("size")) - F.greatest("lo", "start"))
    taken = scratch.table(met.groupBy("sid", "chunk", "place").agg(F.sum(words).alias("taken")), "taken").select(F.col("sid").alias("ts"), F.col("chunk").alias("tc"), F.col("place").alias("tp"), "taken")
    out = laid.join(taken, (F.col("sid") == F.col("ts")) & (F.col("chunk") == F.col("tc")) & (F.col("place") == F.col("tp")), "left")
    out = out.join(lengths, F.col("sid") == F.col("s"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", s: Settings = Settings()) -> DataFrame:
    """The mix as rows: each row of ``df``, with all its columns, as many times as its
    words are taken (to the nearest whole number, so at most the one document that a
    source's cut falls in differs from ``taken``).

    Tapes are shuffled by a hash of the whole row, so the mix does not depend on how rows
    lie in files; rows that are alike in all columns may stand for each other.  Columns of
    any name are kept, those of the operator's own working names too.
    """
    scratch = Scratch(df.sparkSession, "repeat")
    row = free_name(df, "row")
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marked = scratch.table(df.select("*", F.monotonically_increasing_id().alias(row)), "rows")
    taken = mix(marked, row, text_col, source_col, s, F.xxhash64(*hashed, F.lit(7)))
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    copies = taken.where("size > 0").select(F.col(row), F.sequence(F.lit(1), times).alias("copies"), times.alias("times")).where("times > 0")
    copies = scratch.table(copies.select(F.col(row).alias(f"{row}_of"), "copies"), "copies")
    # By sorting: both sides grow with the corpus.
    met = marked.hint("merge").join(copies, marked[row] == copies[f"{row}_of"])
    return met.select(*(marked[f"`{c}`"] for c in df.columns), F.explode(copies["copies"]).alias(row)).drop(row)
