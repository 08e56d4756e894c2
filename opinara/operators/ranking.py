"""Exact order statistics without a hot group.

A window over a label or a day puts that whole group into one task. Here the group is first
counted in slices (hash prefixes or value bins), the slice that holds the wanted row is counted
again in finer slices, and only what is small by then is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.session import cut

MAX_BROADCAST_ROWS = 100_000
SLICE_ROWS = 1_000_000  # rows that one task may order
ROWS_PER_TASK = 10_000  # rows below which an extra task costs more than it saves
PREFIX_CHARS = 2
BINS = 1024


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Store a derived lookup table once; mark it for broadcast only when its count allows.

    Past the limit the join stays a shuffle join, whose skewed partitions AQE splits.
    """
    stored = cut(df)
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def resident(df: DataFrame) -> DataFrame:
    """Keep rows for an iterative fit, without near-empty partitions: each costs a task per iteration."""
    return df.coalesce(df.count() // ROWS_PER_TASK + 1).persist(StorageLevel.MEMORY_AND_DISK)


def lookup(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a lookup table on equally named columns, nulls matching nulls."""
    renamed = side.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in side.columns])
    condition = F.lit(True)
    for name in on:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_on_{name}"))
    return df.join(renamed, condition, how).drop(*[f"_on_{name}" for name in on])


def hash_key(key: Column, seed: int) -> Column:
    """A reproducible pseudo-random order: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_cuts(df: DataFrame, key: Column, quotas: dict[str, Column], strata: Sequence[str] = ()) -> DataFrame:
    """Per stratum, the hash key of its quota-th row in hash order.

    ``quotas`` maps a name to an expression over ``total``, the size of the stratum. The result
    has the strata columns and ``cuts``, a map from name to key; a quota of zero has no entry.

    Rows are counted per hash prefix; the prefix holding the wanted row is split by longer
    prefixes until it is small, and only then ordered. Rows sharing a key stay together.
    """
    strata = list(strata)
    keyed = df.select(*strata, key.alias("_key"))

    def prefixed(chars: int) -> DataFrame:
        return keyed.withColumn("_prefix", F.substring("_key", 1, chars))

    def upto(*groups: str) -> Column:
        order = Window.partitionBy(*groups).orderBy("_prefix")
        return F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))

    wanted = F.array(*[F.struct(F.lit(name).alias("cut"), q.cast("long").alias("_need")) for name, q in quotas.items()])
    counts = prefixed(PREFIX_CHARS).groupBy(*strata, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumns({"_upto": upto(*strata), "total": F.sum("_n").over(Window.partitionBy(*strata))})
    candidates = placed.select(*strata, "_prefix", "_n", "_upto", F.inline(wanted))
    chars = PREFIX_CHARS
    while True:
        before = F.col("_upto") - F.col("_n")
        hit = (F.col("_need") > before) & (F.col("_need") <= F.col("_upto"))
        slices = cut(
            candidates.filter(hit).select(*strata, "_prefix", "_n", "cut", (F.col("_need") - before).alias("_need"))
        )
        largest = slices.agg(F.max("_n")).first()[0] or 0
        inside = lookup(prefixed(chars), small_side(slices.drop("_n")), [*strata, "_prefix"])
        if largest <= SLICE_ROWS or chars >= 32:
            break
        chars += PREFIX_CHARS
        longer = inside.withColumn("_prefix", F.substring("_key", 1, chars))
        finer = longer.groupBy(*strata, "cut", "_need", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
        candidates = finer.withColumn("_upto", upto(*strata, "cut"))
    keys = inside.groupBy(*strata, "cut", "_need", "_key").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*strata, "cut").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    reached = keys.withColumn("_upto", F.sum("_n").over(order)).filter("_upto >= _need")
    found = reached.groupBy(*strata, "cut").agg(F.min("_key").alias("_key"))
    return found.groupBy(*strata).agg(F.map_from_entries(F.collect_list(F.struct("cut", "_key"))).alias("cuts"))


def with_hash_cuts(
    df: DataFrame, key: Column, quotas: dict[str, Column], strata: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, Column]]:
    """The frame joined to its cuts, and one boolean per quota: is the row among the first ones?"""
    cuts = small_side(hash_cuts(df, key, quotas, strata))
    keyed = df.withColumn("_hash", key)
    if strata:
        joined = lookup(keyed, cuts, list(strata), "left")
        bound = F.col("cuts")
    else:
        row = cuts.first()  # one row: a key per quota
        found = row["cuts"] if row else {}
        joined = keyed
        bound = F.create_map(*[F.lit(x) for pair in (found or {"": ""}).items() for x in pair])
    inside = {name: F.coalesce(F.col("_hash") <= F.try_element_at(bound, F.lit(name)), F.lit(False)) for name in quotas}
    return joined, inside


def take_first_by_hash(df: DataFrame, key: Column, quota: Column, strata: Sequence[str] = ()) -> DataFrame:
    """Exactly ``quota`` rows per stratum (an expression over ``total``), in hash order."""
    joined, inside = with_hash_cuts(df, key, {"take": quota}, strata)
    return joined.filter(inside["take"]).select(*df.columns)


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Global 1-based position under a total order.

    The sort is a range shuffle, so a hot leading value is spread by the columns after it.
    Partition sizes (one row per partition) turn in-partition offsets into global ones.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + inner + 1).cast("long").alias(name)
    )


def _magnitude(v: Column) -> Column:
    """An increasing function of all doubles with finite values."""
    finite = F.signum(v) * F.log1p(F.abs(v))
    return F.when(v == float("inf"), 1000.0).when(v == float("-inf"), -1000.0).otherwise(finite)


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated percentiles: rows (by..., p, percentile).

    Each percentile is one or two ranks. The value range of a group is cut into bins that are only
    counted; the bin holding a rank becomes the next, narrower range. Once a range holds few rows,
    or a single value however often it occurs, its distinct values are counted and the rank read off.
    """
    by = list(by)
    v = F.col(value).cast("double")
    data = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    place = F.col("p") * (F.col("_total") - 1)
    ends = F.array(F.floor(place).cast("long"), F.ceil(place).cast("long"))
    bounds = data.groupBy(*by).agg(F.count("_v").alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    targets = (
        bounds.filter("_total > 0")
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .select(*by, "p", "_total", "_low", "_high", F.lit(0).cast("long").alias("_before"), F.col("_total").alias("_n"),
                F.explode(F.array_distinct(ends)).alias("_rank"))
    )
    span = [*by, "_low", "_high"]

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows with the range of their group they fall into."""
        each = F.struct("_low", "_high")
        if by:
            held = small_side(ranges.groupBy(*by).agg(F.collect_set(each).alias("_ranges")))
            spread = lookup(data, held, by)
        else:
            pairs = ranges.select("_low", "_high").distinct().collect()  # at most two ranges per percentile
            literal = [F.struct(F.lit(r["_low"]).alias("_low"), F.lit(r["_high"]).alias("_high")) for r in pairs]
            spread = data.withColumn("_ranges", F.array(*literal))
        fits = F.filter("_ranges", lambda r: (F.col("_v") >= r["_low"]) & (F.col("_v") <= r["_high"]))
        return spread.select(*by, "_v", F.inline(fits))

    while True:
        targets = cut(targets)
        widest = targets.filter("_low < _high").agg(F.max("_n")).first()[0]
        if widest is None or widest <= SLICE_ROWS:
            break
        wide = targets.filter((F.col("_low") < F.col("_high")) & (F.col("_n") > SLICE_ROWS))
        # Ranges that no double can span are cut by order of magnitude; infinities are bins of their own.
        spans = F.abs(F.col("_high") - F.col("_low")) < F.lit(float("inf"))
        on = lambda c: F.when(spans, F.col(c)).otherwise(_magnitude(F.col(c)))
        share = (on("_v") - on("_low")) / (on("_high") - on("_low"))
        binned = inside(wide).withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = binned.groupBy(*span, "_bin").agg(
            F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
        )
        order = Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        steps = counts.withColumn("_upto", F.sum("_m").over(order))
        below = F.col("_before") + F.col("_upto") - F.col("_m")
        narrowed = (
            lookup(wide, steps, span)
            .filter((F.col("_rank") >= below) & (F.col("_rank") < below + F.col("_m")))
            .select(*by, "p", "_total", F.col("_from").alias("_low"), F.col("_to").alias("_high"),
                    below.alias("_before"), F.col("_m").alias("_n"), "_rank")
        )
        settled = targets.filter((F.col("_low") == F.col("_high")) | (F.col("_n") <= SLICE_ROWS))
        targets = settled.unionByName(narrowed)

    single = targets.filter("_low = _high").withColumn("_value", F.col("_low"))
    spread_out = targets.filter("_low < _high")
    if widest is not None:
        values = inside(spread_out).groupBy(*span, "_v").agg(F.count(F.lit(1)).alias("_m"))
        order = Window.partitionBy(*span).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        upto = values.withColumn("_upto", F.sum("_m").over(order)).drop("_m")
        reached = lookup(spread_out, upto, span).filter(F.col("_before") + F.col("_upto") > F.col("_rank"))
        read = reached.groupBy(*targets.columns).agg(F.min("_v").alias("_value"))
        single = single.unionByName(read)
    edges = single.groupBy(*by, "p", "_total").agg(
        F.min_by("_value", "_rank").alias("_lower"), F.max_by("_value", "_rank").alias("_upper")
    )
    fraction = place - F.floor(place)
    between = F.col("_lower") * (1 - fraction) + F.col("_upper") * fraction
    between = F.when((fraction == 0) | (F.col("_lower") == F.col("_upper")), F.col("_lower")).otherwise(
        F.when(F.abs(F.col("_upper") - F.col("_lower")) < F.lit(float("inf")), F.col("_lower") + (F.col("_upper") - F.col("_lower")) * fraction).otherwise(between)
    )
    return edges.select(*by, "p", between.alias("percentile"))
