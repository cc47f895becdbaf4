"""Ordered sequences and intervals: runs, gaps, levels, coverage, range and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` in order. With ``span``, a key is split into slices of so many order
    values: sums run within slices, and each slice starts from the total of those before it, so that one long sequence
    is spread over many tasks. Order values are numbers without ties."""
    if span is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    sliced = df.withColumns({"_value": value, "_slice": F.floor(F.col(order) / span)})
    own = [*keys, "_slice"]
    totals = sliced.groupBy(*own).agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(_ordered(keys, "_slice").rowsBetween(Window.unboundedPreceding, -1))
    first = totals.select(*own, F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.sum("_value").over(Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sliced.withColumn("_inner", inner).join(first, own).withColumn(name, F.col("_before") + F.col("_inner")).drop("_value", "_slice", "_before", "_inner")


def _ordered(keys: list[str], order: str):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)


def runs(df: DataFrame, keys: list[str], order: str, holds: Column, min_length: int = 2, span: int | None = None) -> DataFrame:
    """(keys, start, stop): maximal runs of ``order`` values where ``holds``, both ends inside, kept if
    stop - start >= ``min_length`` (so a run has at least one more element than that). ``span`` as in :func:`running`."""
    marked = df.withColumn("_h", F.coalesce(holds, F.lit(False)))
    islands = running(marked, keys, order, F.when(F.col("_h"), 0).otherwise(1), "_g", span).filter("_h")
    found = islands.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("stop"))
    return found.filter(F.col("stop") - F.col("start") >= min_length).drop("_g")


def join_gaps(intervals: DataFrame, keys: list[str], max_gap: int = 1) -> DataFrame:
    """Merge intervals (start, stop) whose start is at most ``max_gap`` after the greatest stop before it."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") - before > max_gap), 1).otherwise(0)
    marked = intervals.withColumn("_o", opens)
    grouped = marked.withColumn("_g", F.sum("_o").over(w))
    return grouped.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def make_intervals(df: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """(keys, ibd, start, stop): tracts where the level is at least 1, and tracts where it is 2."""
    one = runs(df, keys, order, F.col(level) >= 1, 1).withColumn("ibd", F.lit(1))
    two = runs(df, keys, order, F.col(level) >= 2, 1).withColumn("ibd", F.lit(2))
    return one.unionByName(two)


def rasterise(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, value): how many closed intervals cover each place that any covers.

    Boundary events and a running sum, so the work follows the intervals; the stretches between events are spread
    out at the end only."""
    return spread(coverage(intervals, keys), keys)


def coverage(intervals: DataFrame, keys: list[str], span: int | None = None) -> DataFrame:
    """(keys, start, stop, value): stretches of equal positive coverage. With ``span``, as in :func:`running`: sums and
    the ends of stretches are found within slices, and from the table of slices at their edges."""
    ends = F.array(F.struct(F.col("start").alias("i"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("i"), F.lit(-1).alias("d")))
    events = intervals.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.i", "_e.d")  # one pass: a union would make the intervals twice
    summed = events.groupBy(*keys, "i").agg(F.sum("d").alias("d"))
    if span is None:
        w = Window.partitionBy(*keys).orderBy("i")
        out = summed.withColumns({"value": F.sum("d").over(w), "_next": F.lead("i").over(w)})
    else:
        own = [*keys, "_slice"]
        sliced = summed.withColumn("_slice", F.floor(F.col("i") / span))
        edge = sliced.groupBy(*own).agg(F.sum("d").alias("_d"), F.min("i").alias("_first"))
        w, inner = _ordered(keys, "_slice"), Window.partitionBy(*own).orderBy("i")
        edge = edge.select(*own, F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.lead("_first").over(w).alias("_after"))
        out = sliced.withColumns({"_in": F.sum("d").over(inner), "_lead": F.lead("i").over(inner)}).join(edge, own)
        out = out.withColumns({"value": F.col("_s") + F.col("_in"), "_next": F.coalesce("_lead", "_after")})
    return out.filter("value > 0").select(*keys, F.col("i").alias("start"), (F.col("_next") - 1).alias("stop"), "value")


def spread(stretches: DataFrame, keys: list[str]) -> DataFrame:
    return stretches.select(*keys, F.explode(F.sequence("start", "stop")).alias("i"), "value")


def set_intervals(intervals: DataFrame, keys: list[str], value: int) -> DataFrame:
    """(keys, i, value): places inside any closed interval, set to ``value``."""
    return spread(coverage(intervals, keys), keys).withColumn("value", F.lit(value))


#: Length classes of segments, each eight times as long as the one before; longer segments are a class without bins.
CLASSES, TIMES = 9, 8


def covering(points: DataFrame, segments: DataFrame, on: list[str], point: str = "pos", width: int = 64) -> DataFrame:
    """Range join: points ⨝ segments with start <= point <= stop.

    Segments of up to ``width``, 8 ``width``, 64 ``width``, ... positions are binned by their start with bins as wide as
    their class is long, so a segment of any length is one row and reaches at most into the bin after its own. A point looks
    into two bins of each class. Both sides meet by equality of class and bin: no nested-loop join is planned, and a point
    meets no more segments than lie within some lengths of it."""
    widths = [width * TIMES**k for k in range(CLASSES)]
    length = F.col("stop") - F.col("start")
    level, at = F.lit(CLASSES), F.lit(0).cast("long")
    for k in range(CLASSES - 1, -1, -1):
        level = F.when(length < widths[k], k).otherwise(level)
        at = F.when(length < widths[k], F.floor(F.col("start") / widths[k])).otherwise(at)
    binned = segments.filter("start <= stop").withColumns({"_level": level, "_bin": at})
    looks = [(F.lit(k), F.floor(F.col(point) / w) - back) for k, w in enumerate(widths) for back in (0, 1)] + [(F.lit(CLASSES), F.lit(0).cast("long"))]
    probes = points.withColumn("_look", F.explode(F.array(*[F.struct(k.alias("_level"), b.alias("_bin")) for k, b in looks])))
    probes = probes.select(*points.columns, "_look._level", "_look._bin")
    return probes.join(binned, [*on, "_level", "_bin"]).filter(F.col(point).between(F.col("start"), F.col("stop"))).drop("_level", "_bin")


#: Points of a bin in which ranks are looked up, about.
BIN = 16
#: Points of a block, about, that segments are dealt out by; points of a row of a block at most; shares of the segments of a block.
BLOCK, CHUNK, SHARES = 4096, 512, 8


def rank_bins(points: DataFrame, on: list[str], point: str) -> DataFrame:
    """(on, _bin, _first, _width, _bins, _rank, _held): the points of each key in bins of equal width, how many of them stand
    before a bin, and those in it, sorted. Bins are as many as the points ask for, whatever their distances."""
    own = points.filter(F.col(point).isNotNull()).select(*on, F.col(point).alias("_p"))
    size = own.groupBy(*on).agg(F.min("_p").cast("double").alias("_first"), F.max("_p").cast("double").alias("_last"), F.count("*").alias("_n"))
    size = size.withColumn("_bins", F.greatest(F.lit(1), F.ceil(F.col("_n") / BIN)).cast("int")).withColumn("_width", F.greatest(F.lit(1e-9), (F.col("_last") - F.col("_first")) / F.col("_bins")))
    held = own.join(size.select(*on, "_first", "_width", "_bins"), on)
    held = held.withColumn("_bin", _bin_of(F.col("_p"))).groupBy(*on, "_bin").agg(F.sort_array(F.collect_list("_p")).alias("_held"))
    every = size.select(*on, "_first", "_width", "_bins", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("_bin"))
    both = every.join(held, [*on, "_bin"], "left").withColumn("_held", F.coalesce("_held", F.array().cast(held.schema["_held"].dataType)))
    before = _ordered(on, "_bin").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_rank", F.coalesce(F.sum(F.size("_held")).over(before), F.lit(0)))


def _bin_of(value: Column) -> Column:
    # held within the bins before it becomes a whole number: far from a single point the quotient has no place among them
    return F.greatest(F.lit(0.0), F.least((F.col("_bins") - 1).cast("double"), (value.cast("double") - F.col("_first")) / F.col("_width"))).cast("int")


def ranks(df: DataFrame, bins: DataFrame, on: list[str], values: dict[str, tuple[str, bool]], how: str = "inner") -> DataFrame:
    """``df`` with columns of ``values``, each the number of points before another column's value, or (True) up to it. Keys without
    points are left out, or have null ranks with ``how`` "left". A value meets the points of one small bin."""
    shape = bins.filter("_bin = 0").select(*on, "_first", "_width", "_bins")
    out = df.join(shape, on, how)
    for name, (value, inclusive) in values.items():
        mine = bins.select(*on, F.col("_bin").alias("_b"), F.col("_rank").alias("_r"), F.col("_held").alias("_m"))
        place = F.when(F.col(value) == float("inf"), F.col("_bins") - 1).otherwise(_bin_of(F.col(value)))
        within = F.expr(f"size(filter(_m, x -> x {'<=' if inclusive else '<'} {value}))")
        out = out.withColumn("_b", place).join(mine, [*on, "_b"], how).withColumn(name, (F.col("_r") + within).cast("long")).drop("_b", "_r", "_m")
    return out.drop("_first", "_width", "_bins")


def point_blocks(points: DataFrame, on: list[str], point: str) -> tuple[DataFrame, DataFrame]:
    """(on, _first, _width, _bins) and (on, _block, _share, _low, _high, _points): the points of each key in blocks of equal width, as many
    as the points ask for, in sorted rows of ``CHUNK`` points at most. A block is there once for each share of its segments."""
    own = points.filter(F.col(point).isNotNull()).select(*on, F.col(point).alias("_p"))
    size = own.groupBy(*on).agg(F.min("_p").cast("double").alias("_first"), F.max("_p").cast("double").alias("_last"), F.count("*").alias("_n"))
    size = size.withColumn("_bins", F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)).cast("int"))
    size = size.select(*on, "_first", F.greatest(F.lit(1e-9), (F.col("_last") - F.col("_first")) / F.col("_bins")).alias("_width"), "_bins")
    placed = own.join(size, on).select(*on, _bin_of(F.col("_p")).alias("_block"), "_p")
    row = F.floor((F.row_number().over(Window.partitionBy(*on, "_block").orderBy("_p")) - 1) / CHUNK)
    held = placed.withColumn("_row", row).groupBy(*on, "_block", "_row").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"), F.sort_array(F.collect_list("_p")).alias("_points"))
    return size, held.select(*on, "_block", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"), "_low", "_high", "_points")


def dealt(segments: DataFrame, size: DataFrame, on: list[str], whose: list[str]) -> DataFrame:
    """(segment columns, _block, _share): each segment once for each block that it reaches into, dealt out by block and share.
    Segments that agree in ``whose`` meet in one share."""
    cols = segments.columns
    first, last = _bin_of(F.col("start")), _bin_of(F.col("stop"))
    placed = segments.filter("start <= stop").join(size, on).select(*cols, F.explode(F.sequence(first, last)).alias("_block"))
    # so many tasks whatever the segments' size: the points that they meet are many times as large
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.withColumn("_share", F.pmod(F.xxhash64(*whose), F.lit(SHARES)).cast("int")).repartition(tasks, *on, "_block", "_share")


def _among(low: str, value: str, inclusive: bool) -> Column:
    """How many of the sorted ``_points`` stand before ``value``, or up to it: by halves."""
    halves = [CHUNK >> k for k in range(CHUNK.bit_length())]
    test = "<=" if inclusive else "<"
    step = f"case when n + h <= size(_points) and _points[n + h - 1] {test} {value} then n + h else n end"
    return F.when(F.col(low) <= F.col(value) if inclusive else F.col(low) < F.col(value), F.expr(f"aggregate(array({', '.join(map(str, halves))}), 0, (n, h) -> {step})")).otherwise(0)


def met(segments: DataFrame, blocks: DataFrame, on: list[str], point: str) -> DataFrame:
    """(segment columns, point): the points of its block inside each of the segments of :func:`dealt`, without moving them again."""
    cols = [c for c in segments.columns if c not in ("_block", "_share")]
    found = segments.join(blocks.hint("shuffle_hash"), [*on, "_block", "_share"]).filter("start <= _high and stop >= _low")
    first = _among("_low", "start", False)
    last = F.when(F.col("stop") >= F.col("_high"), F.size("_points")).otherwise(_among("_low", "stop", True))
    found = found.select(*cols, "_points", first.alias("_from"), last.alias("_to"))
    n = F.col("_to") - F.col("_from")
    return found.select(*cols, F.explode(F.when(n == F.size("_points"), F.col("_points")).otherwise(F.slice("_points", F.col("_from") + 1, n))).alias(point))


def points_inside(points: DataFrame, segments: DataFrame, on: list[str], point: str = "pos") -> DataFrame:
    """(segment columns, point): every point inside each segment, both ends inside; of ``points`` only ``on`` and ``point`` are read.

    Points lie in blocks of equal width, so a segment tells from its ends which blocks it reaches into: it is moved once for each,
    about once for every ``BLOCK`` points that it holds, and once at least. Within a block its ends are found by halves."""
    size, blocks = point_blocks(points, on, point)
    return met(dealt(segments, size, on, segments.columns), blocks, on, point).select(*segments.columns, point)


#: Places of a bucket in a search for the nearest, about.
HELD = 4096


def nearest(probes: DataFrame, markers: DataFrame, on: list[str], probe: str = "pos", marker: str = "bp", index: str = "marker_idx", bucket: int = 100_000) -> DataFrame:
    """Each probe with the index of the nearest marker; of two equally near the left one.

    Equal probes are one row until the end. Two levels, so one chromosome is spread over buckets of up to ``bucket`` positions,
    narrower ones where they would hold more than some thousand rows: within a bucket, running windows over probes and markers
    together; the last marker before and the first after each bucket come from the bucket table."""
    m = markers.select(*on, F.col(marker).alias("_p"), F.lit(1).alias("_o"), F.struct(F.col(marker).alias("p"), F.col(index).alias("i")).alias("_m"))
    p = probes.select(*on, F.col(probe).alias("_p")).filter("_p is not null").distinct().select(*on, "_p", F.lit(2).alias("_o"), F.lit(None).cast(m.schema["_m"].dataType).alias("_m"))
    both = m.unionByName(p)
    size = both.groupBy(*on).agg(F.min("_p").cast("double").alias("_from"), F.max("_p").cast("double").alias("_to"), F.ceil(F.count("*") / HELD).alias("_n"))
    width = F.least(F.lit(float(bucket)), F.greatest(F.lit(1e-9), (F.col("_to") - F.col("_from")) / F.col("_n")))
    both = both.join(size.select(*on, "_from", width.alias("_width")), on).withColumn("_b", F.floor((F.col("_p") - F.col("_from")) / F.col("_width"))).drop("_from", "_width")
    edge = both.groupBy(*on, "_b").agg(F.min("_m").alias("_first"), F.max("_m").alias("_last"))
    wb = Window.partitionBy(*on).orderBy("_b")
    edge = edge.withColumns(
        {
            "_before": F.last("_last", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)),
            "_after": F.first("_first", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).drop("_first", "_last")
    w = Window.partitionBy(*on, "_b")
    local = both.withColumns(
        {
            "_l": F.last("_m", ignorenulls=True).over(w.orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)),
            "_r": F.last("_m", ignorenulls=True).over(w.orderBy(F.col("_p").desc(), F.col("_o")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("_o = 2")
    found = local.join(edge, [*on, "_b"])
    left, right = F.coalesce("_l", "_before"), F.coalesce("_r", "_after")
    take_right = left.isNull() | (right.isNotNull() & (right["p"] - F.col("_p") < F.col("_p") - left["p"]))
    found = found.select(*on, F.col("_p").alias(probe), F.when(take_right, right["i"]).otherwise(left["i"]).alias("_found"))
    return probes.join(found, [*on, probe]).select(*on, *[c for c in probes.columns if c not in on], F.col("_found").alias(index))


def cumsum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def is_sorted(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, is_sorted): whether the values never fall."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.withColumn("_ok", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True)))
    return step.groupBy(*keys).agg(F.bool_and("_ok").alias("is_sorted"))


def random_rows(df: DataFrame, n: int, key: Column, seed: int) -> DataFrame:
    """``n`` distinct rows of smallest seeded hash."""
    if n > df.count():
        from ..errors import IterationError

        raise IterationError("fewer rows than asked for")
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(n)


def key_set(a: DataFrame, b: DataFrame, how: str, key: str = "k") -> DataFrame:
    """Union or intersection of two key sets."""
    return a.select(key).union(b.select(key)).distinct() if how == "union" else a.select(key).intersect(b.select(key))


def key_range(a: DataFrame, start: int, stop: int, key: str = "k", keep: bool = True) -> DataFrame:
    """Keys of the half-open range, or those outside of it."""
    inside = (F.col(key) >= start) & (F.col(key) < stop)
    return a.filter(inside if keep else ~inside)
