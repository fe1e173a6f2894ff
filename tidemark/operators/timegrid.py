"""Regular grids, as-of lookups and forward fill.

All of them are linear: union plus an ordered window, never a join on an inequality.
``span`` cuts long series into time spans with the last known row carried into each
(see ``blocks``). ``span=None`` runs one window per key and is for series of bounded
length per key, such as bars and daily series.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import earlier, last_known, ordered, ratio_change, so_far, whole
from ..functions.timing import floor_to, from_micros, micros, micros_of, slot, step
from .blocks import filled, time_cut

FOUR_HOURS = timedelta(hours=4)
ONE_DAY = timedelta(days=1)


GRID_CHUNK = 10_000


def span_grid(bounds: DataFrame, width: timedelta, ts: str = "ts") -> DataFrame:
    """Rows with times ``lo`` and ``hi`` -> one row per grid point from lo to hi.

    Expanded in two steps, so no single row ever grows by more than ``GRID_CHUNK`` points.
    """
    size = F.lit(GRID_CHUNK)
    rest = [c for c in bounds.columns if c not in ("lo", "hi")]
    chunks = bounds.select(
        *rest, slot(F.col("lo"), width).alias("_lo"), slot(F.col("hi"), width).alias("_hi"),
    ).withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    points = F.sequence(F.greatest(F.col("_lo"), F.col("_chunk") * size),
                        F.least(F.col("_hi"), F.col("_chunk") * size + size - 1))
    return (
        chunks.withColumn("_point", F.explode(points))
        .select(*rest, from_micros(F.col("_point") * F.lit(micros_of(width))).alias(ts))
    )


def grid_of(series: DataFrame, width: timedelta = FOUR_HOURS, keys: Sequence[str] = ("symbol",),
            ts: str = "ts") -> DataFrame:
    """Per key, every grid point from floor(first time) to floor(last time)."""
    bounds = series.groupBy(*keys).agg(
        floor_to(F.min(ts), width).alias("lo"), floor_to(F.max(ts), width).alias("hi"))
    return span_grid(bounds, width, ts)


# Rows of both sides that a task is given at most, roughly, and into how many pieces a span can fall.
ROWS_PER_PIECE = 1_000_000
MOST_PIECES = 4_096
BROADCAST_BOUNDS = 250_000  # numbers a task may be sent


def pieces(left: DataFrame, right: DataFrame, parts: Sequence[str], ts: str, rows: int) -> DataFrame | None:
    """Spans (``parts``) with more than ``rows`` rows of both sides together -> ``_bounds``: times that cut
    them into pieces of about ``rows`` rows, a time as often as pieces end at it. None without such spans.

    Counts and quantile sketches are aggregated map-side; the sketch sees the rows of hot spans only.
    The counting runs at once, and two numbers come back: how many hot spans there are, and pieces.
    """
    both = left.select(*parts, ts).unionByName(right.select(*parts, ts)).filter(F.col(ts).isNotNull())
    hot = both.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    wanted = F.least(F.ceil(F.col("_n") / rows), F.lit(MOST_PIECES)).cast("int")
    n_spans, n_pieces = hot.agg(F.count(F.lit(1)), F.sum(wanted)).first()
    if not n_spans:
        return None
    few = n_spans <= BROADCAST_BOUNDS
    grid = [i / MOST_PIECES for i in range(1, MOST_PIECES)]
    cuts = F.transform(F.sequence(F.lit(1), F.col("_p") - 1), lambda j: F.element_at("_grid", F.floor(j * MOST_PIECES / F.col("_p")).cast("int")))
    found = (
        both.join(F.broadcast(hot) if few else hot, list(parts)).groupBy(*parts)
        .agg(F.max("_n").alias("_n"), F.percentile_approx(micros(F.col(ts)), grid, 4 * MOST_PIECES).alias("_grid"))
        .withColumn("_p", wanted).select(*parts, cuts.alias("_bounds"))
    )
    return F.broadcast(found) if n_pieces <= BROADCAST_BOUNDS else found


def _passed(bounds: Column, at: Column, strict: bool) -> Column:
    """How many of the ascending ``bounds`` are below ``at`` (or at it, unless ``strict``), by bisection."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_PIECES.bit_length()))])

    def step_up(found: Column, jump: Column) -> Column:
        probe = F.get(bounds, found + jump - 1)
        return F.when(probe < at if strict else probe <= at, found + jump).otherwise(found)

    return F.coalesce(F.aggregate(halves, F.lit(0), step_up), F.lit(0))


def dealt(left: DataFrame, right: DataFrame, parts: Sequence[str], ts: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (``_left``, ``_right``) with ``_piece``, the part of its span a row falls into.

    Pieces follow each other in time. Where so many rows share one time that several pieces
    end at it, the left rows of that time are dealt over them, and the right rows, of which
    only the last counts, are reduced to it.
    """
    cuts = pieces(left, right, parts, ts, rows)
    if cuts is None:
        return tuple(d.withColumn("_piece", F.lit(0)) for d in (left, right))
    at = micros(F.col(ts))

    def placed(df: DataFrame) -> DataFrame:
        return (
            df.join(cuts, list(parts), "left")
            .withColumn("_piece", _passed(F.col("_bounds"), at, True))
            .withColumn("_shared", F.when(F.col("_bounds").isNotNull(), _passed(F.col("_bounds"), at, False) - F.col("_piece")).otherwise(0))
            .drop("_bounds")
        )

    l = placed(left).withColumn("_piece", F.col("_piece") + F.when(
        F.col("_shared") > 1, F.pmod(F.xxhash64("_left"), F.col("_shared")).cast("int")).otherwise(0)).drop("_shared")
    r = placed(right)
    crowded = r.filter("_shared > 1").groupBy(*parts, "_piece", ts).agg(
        F.max_by("_right", "_tie").alias("_right"), F.max("_tie").alias("_tie")).withColumn("_side", F.lit(0))
    return l, r.filter("_shared <= 1").drop("_shared").unionByName(crowded, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts",
              span: timedelta | None = ONE_DAY, tie: Sequence[str] = (), rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    The right row is taken whole, so its NULLs are kept. ``tie`` orders right rows of
    equal time. Left rows without a match stay, with NULLs.

    Long series are cut into spans of time, and spans with many rows, on either side, by
    themselves into pieces of about ``rows_per_piece`` rows. Each span or piece opens with the
    last right row before it, found by a scan over their ends.
    """
    payload = [c for c in right.columns if c not in (*keys, ts)]
    tie = list(tie)
    r = right.select(
        *keys, ts, F.lit(0).alias("_side"),
        F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"),
        F.struct(*payload).alias("_right"), F.lit(None).cast(left.schema).alias("_left"))
    l = left.select(
        *keys, ts, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(r.schema["_right"].dataType).alias("_right"),
        F.struct(*left.columns).alias("_left"))
    parts = list(keys)
    if span is None:
        rows = r.unionByName(l)
    else:
        r, l = (d.withColumn("_span", slot(F.col(ts), span)) for d in (r, l))
        l, r = dealt(l, r, [*keys, "_span"], ts, rows_per_piece)
        parts = [*keys, "_span", "_piece"]
        ends = r.groupBy(*parts).agg(
            F.max_by("_right", F.struct(ts, "_tie")).alias("_right")).withColumn("_side", F.lit(1))
        starts = l.select(*parts).distinct().select(
            *parts, F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.lit(0).alias("_side"))
        # one row per piece with left rows: the last right row of all earlier pieces
        opens = (
            ends.unionByName(starts)
            .withColumn("_right", F.last("_right", ignorenulls=True)
                        .over(earlier(ordered(keys, "_span", "_piece", "_side"))))
            .filter((F.col("_side") == 0) & F.col("_right").isNotNull())
            .withColumn("_side", F.lit(-1))
        )
        rows = r.unionByName(opens, allowMissingColumns=True).unionByName(l)
    w = so_far(ordered(parts, F.asc_nulls_first(ts), "_side", "_tie"))
    return (
        rows.withColumn("_right", F.last("_right", ignorenulls=True).over(w))
        .filter(F.col("_left").isNotNull())
        .select("_left.*", *[F.col("_right")[c].alias(c) for c in payload])
    )


def asof_grid(series: DataFrame, width: timedelta = FOUR_HOURS, keys: Sequence[str] = ("symbol",),
              ts: str = "ts", span: timedelta | None = ONE_DAY) -> DataFrame:
    """Bring a series on a regular grid; each point takes the last row at or before it.

    A point before the first row is NULL, and a row after the last point is not seen.
    """
    out = asof_join(grid_of(series, width, keys, ts), series, keys, ts, span)
    return out.select(*series.columns)


def asof_on_grid(bars: DataFrame, series: Sequence[DataFrame], width: timedelta = FOUR_HOURS,
                 keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """``asof_grid`` of each series joined to bars on equal time, without building the grids.

    A bar on the grid sees the last row of a series at or before it, up to the last grid
    point of that series. All series and the bars share one shuffle and one sort, and the
    result stays partitioned by key and ordered by time for the windows that follow.
    For series and bars of bounded length per key.
    """
    left = "_bar"
    rows = bars.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*bars.columns).alias(left))
    payloads = []
    for i, one in enumerate(series):
        columns = [c for c in one.columns if c not in (*keys, ts)]
        payloads.append((f"_series{i}", columns))
        rows = rows.unionByName(
            one.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*columns).alias(f"_series{i}")),
            allowMissingColumns=True)
    w = ordered(keys, ts, "_side")
    everything = whole(w)
    seen = {name: last_known(F.col(name), w) for name, _ in payloads}
    ends = {f"_end{name}": F.max(F.when(F.col(name).isNotNull(), F.col(ts))).over(everything) for name, _ in payloads}
    found = rows.withColumns(ends).withColumns(seen).filter(F.col(left).isNotNull())
    on_grid = F.col(ts) == floor_to(F.col(ts), width)
    return found.select(
        *keys, ts, *[F.col(left)[c].alias(c) for c in bars.columns if c not in (*keys, ts)],
        *[F.when(on_grid & (F.col(ts) <= floor_to(F.col(f"_end{name}"), width)), F.col(name)[c]).alias(c)
          for name, columns in payloads for c in columns])


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",),
          order: Sequence[str] = ("ts",), span: timedelta | None = ONE_DAY) -> DataFrame:
    """Replace NULLs by the last non-null value of the same key."""
    if span is not None:
        return filled(df, columns, time_cut(span, keys, order))
    w = ordered(keys, *order)
    return df.select(*[last_known(F.col(c), w).alias(c) if c in columns else F.col(c) for c in df.columns])


def join_left_ts(bars: DataFrame, features: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Left equi-join of aligned features; the strategy is left to the size-aware planner."""
    return bars.join(features, list(keys), "left")


def join_outer_ts(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts",
                  span: timedelta | None = None) -> DataFrame:
    """Full outer join on (keys, time), then forward fill of every value column."""
    joined = a.join(b, [*keys, ts], "full")
    values = [c for c in joined.columns if c not in (*keys, ts)]
    return ffill(joined, values, keys, (ts,), span)


def integrate_ffill(bars: DataFrame, series: DataFrame, width: timedelta = FOUR_HOURS,
                    keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Grid a series, join it to bars, then fill the gap after its last point."""
    values = [c for c in series.columns if c not in (*keys, ts)]
    joined = join_left_ts(bars, asof_grid(series, width, keys, ts, span=None), [*keys, ts])
    return ffill(joined, values, keys, (ts,), span=None)


def pct_change(df: DataFrame, column: str, into: str, keys: Sequence[str] = ("symbol",),
               order: Sequence[str] = ("ts",)) -> DataFrame:
    """Relative change to the previous row, with gaps padded by the last known value first."""
    w = ordered(keys, *order)
    padded = df.withColumn("_pad", last_known(F.col(column), w))
    return padded.withColumn(into, ratio_change(F.col("_pad"), w)).drop("_pad")


def diff_n(df: DataFrame, column: str, n: int, into: str, keys: Sequence[str] = ("symbol",),
           order: Sequence[str] = ("ts",)) -> DataFrame:
    w = ordered(keys, *order)
    return df.withColumn(into, F.col(column) - F.lag(column, n).over(w))


def filter_recent_days(df: DataFrame, days: int, ts: str = "ts", as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (default: the newest row)."""
    newest = as_of if as_of is not None else df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= newest - step(timedelta(days=days)))


def max_ts(df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(ts).alias("max_ts"))


def last_row(df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Newest row per key (times are unique per key), by aggregation with map-side partials."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in rest]).select(*df.columns)
