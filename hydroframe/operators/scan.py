"""Skew-safe ordered scans over long per-station series.

A window partitioned by the station alone puts one station's whole series in one task,
and one station may hold a large share of all rows. The helpers here split every series
into ordered blocks (default: the calendar year of the order column), do the per-row work
inside ``(station, block)`` partitions, and carry the few values that cross a block
boundary through a summary table with one row per station and block (small: rows/366 for
daily data), whose own window is cheap. One pass = one big exchange on (station, block),
one aggregate on the same partitioning, one small carry window and one join. Results
equal those of the plain station window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_blk"
_UNB = Window.unboundedPreceding


def default_block(order_col: str) -> Column:
    """Calendar year of a date column: at most 366 daily rows per station and block."""
    return F.year(F.col(order_col))


def blocked_scan(df: DataFrame, keys: list[str], order_col: str, pos: str | None = "row_pos",
                 fill_cols: list[str] = (), flags: dict[str, Column] | None = None,
                 block: Column | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """One blocked pass adding, per key ordered by ``order_col`` (must be unique per key):

    - ``pos``: 0-based row position;
    - ``<flag>`` for each entry of ``flags``: running count of rows where the condition holds
      (at or before the row);
    - ``<total>`` for each entry of ``totals``: the number of rows of the key where the condition holds, which comes
      with the carried values, without a join on the key alone;
    - for each ``c`` in ``fill_cols``: nearest non-null value and its position at or before the
      row (``c__pv``, ``c__pp``) and at or after it (``c__nv``, ``c__np``).

    In a block: running frames ascending and descending (never a look-ahead frame, which is
    quadratic). Across blocks: prefix sums and last/first known values from the summary.
    """
    flags, totals = flags or {}, totals or {}
    fill_cols = list(fill_cols)
    block = default_block(order_col) if block is None else block
    d = df.withColumn(BLOCK, block)
    wa = Window.partitionBy(*keys, BLOCK).orderBy(F.col(order_col).asc())
    run_a = wa.rowsBetween(_UNB, 0)
    run_d = Window.partitionBy(*keys, BLOCK).orderBy(F.col(order_col).desc()).rowsBetween(_UNB, 0)
    d = d.withColumn("_rn", F.row_number().over(wa) - 1)
    # a known value and its in-block position travel together as one struct (null when unknown)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("p"), F.col(c).alias("v")))
             for c in fill_cols}
    sel = [F.sum(cond.cast("long")).over(run_a).alias(f"_{n}_in") for n, cond in flags.items()]
    for c in fill_cols:
        sel += [F.last(known[c], True).over(run_a).alias(f"{c}__p_in"),
                F.last(known[c], True).over(run_d).alias(f"{c}__n_in")]
    d = d.select("*", *sel)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(cond.cast("long")).alias(f"_{n}_n") for n, cond in flags.items()]
    aggs += [F.count_if(cond).alias(f"_{n}_t") for n, cond in totals.items()]
    for c in fill_cols:
        aggs += [F.max(known[c]).alias(f"{c}__last"), F.min(known[c]).alias(f"{c}__first")]
    summary = d.groupBy(*keys, BLOCK).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(F.col(BLOCK).asc()).rowsBetween(_UNB, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(_UNB, -1)
    summary = summary.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def shifted(col):  # the block's edge value with its global position
        return F.when(F.col(col).isNotNull(), F.struct((F.col("_off") + F.col(col)["p"]).alias("p"),
                                                       F.col(col)["v"].alias("v")))
    carry = [F.col("_off")]
    carry += [F.coalesce(F.sum(f"_{n}_n").over(before), F.lit(0)).alias(f"_{n}_off") for n in flags]
    carry += [F.sum(f"_{n}_t").over(Window.partitionBy(*keys)).alias(f"_{n}_all") for n in totals]
    for c in fill_cols:
        carry += [F.last(shifted(f"{c}__last"), True).over(before).alias(f"{c}__p_c"),
                  F.last(shifted(f"{c}__first"), True).over(after).alias(f"{c}__n_c")]
    carry_df = summary.select(*keys, BLOCK, *carry)
    j = d.join(carry_df, [*keys, BLOCK], "inner")

    off = F.col("_off")
    out = []
    if pos:
        out.append((off + F.col("_rn")).cast("long").alias(pos))
    out += [(F.col(f"_{n}_off") + F.col(f"_{n}_in")).cast("long").alias(n) for n in flags]
    out += [F.col(f"_{n}_all").cast("long").alias(n) for n in totals]
    for c in fill_cols:
        pin, nin, pc, nc = (F.col(f"{c}__{k}") for k in ("p_in", "n_in", "p_c", "n_c"))
        hp, hn = pin.isNotNull(), nin.isNotNull()
        out += [F.when(hp, pin["v"]).otherwise(pc["v"]).alias(f"{c}__pv"),
                F.when(hp, off + pin["p"]).otherwise(pc["p"]).alias(f"{c}__pp"),
                F.when(hn, nin["v"]).otherwise(nc["v"]).alias(f"{c}__nv"),
                F.when(hn, off + nin["p"]).otherwise(nc["p"]).alias(f"{c}__np")]
    return j.select(*df.columns, *out)


def row_index(df: DataFrame, keys: list[str], order_col: str, name: str = "row_pos",
              block: Column | None = None) -> DataFrame:
    """0-based row position within each key (P10 in blocked form)."""
    return blocked_scan(df, keys, order_col, pos=name, block=block)


def neighbour_rows(df: DataFrame, keys: list[str], order_col: str, prev_cols: list[str] = (),
                   next_cols: list[str] = (), block: Column | None = None) -> DataFrame:
    """``lag(c, 1)`` as ``c__prev`` and ``lead(c, 1)`` as ``c__next`` per key, blocked: inside a
    block plain lag/lead; at a block edge the last row of the nearest earlier block, or the
    first row of the nearest later block, from the per-block edge table."""
    prev_cols, next_cols = list(prev_cols), list(next_cols)
    block = default_block(order_col) if block is None else block
    d = df.withColumn(BLOCK, block)
    wa = Window.partitionBy(*keys, BLOCK).orderBy(F.col(order_col).asc())
    d = d.select("*", F.row_number().over(wa).alias("_rn"), F.count(F.lit(1)).over(
        Window.partitionBy(*keys, BLOCK)).alias("_cnt"),
        *[F.lag(c, 1).over(wa).alias(f"{c}__prev_in") for c in prev_cols],
        *[F.lead(c, 1).over(wa).alias(f"{c}__next_in") for c in next_cols])
    edge = d.groupBy(*keys, BLOCK).agg(
        *[F.max_by(F.col(c), F.col(order_col)).alias(f"{c}__last") for c in prev_cols],
        *[F.min_by(F.col(c), F.col(order_col)).alias(f"{c}__first") for c in next_cols])
    wb = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = edge.select(*keys, BLOCK, *[F.lag(f"{c}__last", 1).over(wb).alias(f"{c}__prev_c") for c in prev_cols],
                        *[F.lead(f"{c}__first", 1).over(wb).alias(f"{c}__next_c") for c in next_cols])
    j = d.join(carry, [*keys, BLOCK], "inner")
    out = [F.when(F.col("_rn") == 1, F.col(f"{c}__prev_c")).otherwise(F.col(f"{c}__prev_in")).alias(f"{c}__prev")
           for c in prev_cols]
    out += [F.when(F.col("_rn") == F.col("_cnt"), F.col(f"{c}__next_c")).otherwise(F.col(f"{c}__next_in"))
            .alias(f"{c}__next") for c in next_cols]
    return j.select(*df.columns, *out)


def halo(df: DataFrame, pos: str, before: int, after: int, block_rows: int) -> DataFrame:
    """Copy each row into its own position block and into the neighbouring blocks whose frames
    reach it (``before`` rows back, ``after`` rows ahead); ``_own`` marks the original."""
    if block_rows < max(before, after, 1):
        raise ValueError("block_rows must be at least the frame reach")
    b = F.floor(F.col(pos) / block_rows).cast("long")
    r = F.col(pos) - b * block_rows
    targets = F.array(
        F.struct(b.alias("_pb"), F.lit(True).alias("_own")),
        F.struct(F.when(r >= block_rows - before, b + 1).alias("_pb"), F.lit(False).alias("_own")),
        F.struct(F.when(r < after, b - 1).alias("_pb"), F.lit(False).alias("_own")))
    t = F.filter(targets, lambda s: s["_pb"].isNotNull())
    return df.select("*", F.explode(t).alias("_h")).select(*df.columns, "_h._pb", "_h._own")
