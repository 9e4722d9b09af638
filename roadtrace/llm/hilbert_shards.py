"""Sharding along a Hilbert curve, with SQL functions only.

Several metadata dimensions are quantised to ``bits`` bits each, a row's cell gets its index on the Hilbert curve, rows
are ordered by that index and the order is cut into equal runs. Neighbouring cells on the curve are near in every
dimension, so each run's files carry narrow minima and maxima and predicates on any of the dimensions prune files.

A global order needs no global sort: there are at most 2**(dims*bits) cells, so their cumulative counts are a table of
bounded size. A cell is dealt by a hash of the order columns to one subcell for every ``SUBROWS`` of its rows (one source may hold a
third of all rows), so no task ranks a whole hot cell. The offsets table has at most 2**(dims*bits) + rows / ``SUBROWS`` rows. The input is
read once: rows with their cell are cut off by checkpoint() and counted from there.

Law ``rows``: run s holds positions p with floor(p * shards / n) = s, so counts are at most one apart.

Defined cases: null text counts as no bytes (size 1, checksum 0); null dimensions quantise to 0; null ids rank first
in their subcell; repeated rows take neighbouring slots; an empty table gives no rows; input columns named cell, shard or slot are
replaced, other names may clash with anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm import textkit as tk

BITS = 4
#: Rows of a subcell.
SUBROWS = 1 << 10


def curve_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """Per octant: inverse Gray code, entry corner and direction of the curve, from the Gray-code rule."""
    size = 1 << dims
    gray = [i ^ (i >> 1) for i in range(size)]
    inverse = [gray.index(i) for i in range(size)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(size)]

    def trailing(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    turn = [0 if i == 0 else trailing(i - 1) % dims if i % 2 == 0 else trailing(i) % dims for i in range(size)]
    return inverse, entry, turn


def curve_index(levels: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of the cell with the given integer coordinates (``bits`` bits each)."""
    dims = len(levels)
    inverse, entry, turn = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    mask = (1 << dims) - 1

    def left(value: Column, by: Column) -> Column:
        """Left rotation of a ``dims``-bit number."""
        wide = F.call_function("shiftleft", value, by.cast("int"))
        return wide.bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftright(wide, dims))

    def step(state: Column, level: Column) -> Column:
        corner = sum((F.get(level, F.lit(d)) * F.lit(1 << d) for d in range(1, dims)), F.get(level, F.lit(0)))
        shifted = left(corner.bitwiseXOR(state["entry"]), F.lit(dims) - F.pmod(state["turn"] + F.lit(1), F.lit(dims)))
        octant = F.get(inverse, shifted.cast("int"))
        return F.struct(
            state["entry"].bitwiseXOR(left(F.get(entry, octant).cast("long"), F.pmod(state["turn"] + F.lit(1), F.lit(dims)))).alias("entry"),
            F.pmod(state["turn"] + F.get(turn, octant) + F.lit(1), F.lit(dims)).cast("int").alias("turn"),
            (state["index"] * F.lit(1 << dims) + octant).cast("long").alias("index"),
        )

    planes = F.array(*(F.array(*(F.shiftright(v.cast("int"), b).bitwiseAND(F.lit(1)).cast("long") for v in levels)) for b in reversed(range(bits))))
    start = F.struct(F.lit(0).cast("long").alias("entry"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(planes, start, step, lambda s: s["index"])


def hashed_level(value: Column, bits: int) -> Column:
    """A categorical dimension: its hash bucket, 0 for null."""
    return F.coalesce(F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def log_level(value: Column, bits: int) -> Column:
    """A count or size: its power of two, 0 for null."""
    return F.coalesce(F.least(F.floor(F.log2(F.greatest(value, F.lit(1)))), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def hilbert_shards(df: DataFrame, dimensions: list[Column], *, order: list[str], shards: int, bits: int = BITS, subrows: int = SUBROWS) -> DataFrame:
    """``df`` with cell (curve index), shard (int, 0 to shards-1) and slot (long, gapless from 0 in its shard).

    ``dimensions`` are integer columns below 2**bits; ``order`` names the columns that order rows within a subcell.
    """
    tk.checkpoint_dir(df.sparkSession)
    kept = [c for c in df.columns if c not in ("cell", "shard", "slot")]
    names = {c: f"__row_{i}" for i, c in enumerate(kept)}
    sorts = [f"__order_{i}" for i in range(len(order))]
    own = [*(F.col(c).alias(n) for c, n in names.items()), *(F.col(c).alias(n) for c, n in zip(order, sorts, strict=True))]
    base = df.select(*own, curve_index(dimensions, bits).alias("__cell"), F.xxhash64(*order).alias("__hash")).checkpoint()
    # At most 2**(dims*bits) rows meet in this one task, whatever the input.
    cells = base.groupBy("__cell").agg(F.count("*").alias("__m"))
    all_cells = Window.partitionBy(F.lit(0))
    before = F.sum("__m").over(all_cells.orderBy("__cell")) - F.col("__m")
    cells = cells.select("__cell", before.alias("__before"), F.sum("__m").over(all_cells).alias("__total"), F.ceil(F.col("__m") / subrows).cast("int").alias("__subs"))
    dealt = base.join(F.broadcast(cells.select("__cell", "__subs")), "__cell").withColumn("__sub", F.pmod(F.col("__hash"), F.col("__subs")).cast("int")).drop("__subs", "__hash")
    counts = dealt.groupBy("__cell", "__sub").agg(F.count("*").alias("__n"))
    inner = F.sum("__n").over(Window.partitionBy("__cell").orderBy("__sub")) - F.col("__n")
    offsets = counts.withColumn("__inner", inner).join(F.broadcast(cells), "__cell").select("__cell", "__sub", (F.col("__before") + F.col("__inner")).alias("__offset"), "__total")
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell", "__sub").orderBy(*sorts)) - F.lit(1))
    placed = ranked.join(offsets, ["__cell", "__sub"]).withColumn("__at", F.col("__offset") + F.col("__rank"))
    placed = placed.withColumn("__shard", F.expr(f"CAST((__at * {shards}) DIV __total AS INT)"))
    slot = F.expr(f"__at - (__shard * __total + {shards - 1}) DIV {shards}")
    return placed.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("__cell").alias("cell"), F.col("__shard").alias("shard"), slot.alias("slot"))
