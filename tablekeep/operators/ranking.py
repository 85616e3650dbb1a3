"""Exact row numbers without a one-task window.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts every row of a group in
one task, and with no ``g`` it puts the whole table in one task. Here the rows
are cut into range buckets of the sort order first, so a hot group is spread
over many buckets. One method at every size:

1. bounds: a row sample of the sort key at a fraction that gives about
   ``buckets * SAMPLE_PER_BUCKET`` rows in all, each task sending only its
   share and the driver a fixed number at most; every k-th value is a bound;
2. bucket = binary search in the array of bounds: a pure function of the row,
   so every re-run of a task puts a row in the same bucket (no checkpoint
   needed, no dependence on a shuffle's sampling) and the number of buckets
   may grow with the data;
3. a local ``row_number`` per (bucket, group): one hash shuffle on the bucket;
4. counts per (bucket, group) with map-side combine, and for each group the
   rows it has in earlier buckets. Only a group that crosses a bucket boundary
   has such an offset, so the offset table has fewer rows than there are
   buckets and is broadcast with a proven bound.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_BUCKET = 64
#: Bounds of what the driver holds, whatever the number of partitions: bounds
#: of range buckets, and sampled keys they are taken from.
MOST_BUCKETS = 8_192
MOST_SAMPLED = 1 << 17
_RB = "__rb"
_LRN = "__lrn"
_OFF = "__off"
_CNT = "__cnt"
_KEY = "__key"


def _default_buckets(spark) -> int:
    """As many buckets as shuffle partitions, the setting a cluster sizes to
    its data volume, up to ``MOST_BUCKETS``."""
    return max(1, min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _bounds_below(key: Column, bounds: Column, n: int) -> Column:
    """Number of the ``n`` sorted bounds that are <= ``key``: binary search."""
    steps = [1 << k for k in range(max(n, 1).bit_length() - 1, -1, -1)]

    def step(pos: Column, s: Column) -> Column:
        return F.when((pos + s <= n) & (F.get(bounds, pos + s - 1) <= key), pos + s).otherwise(pos)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _literal_struct(values, fields) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields)])


def range_bucket(df: DataFrame, sort_cols: list[str], buckets: int, seed: int = 17) -> tuple[DataFrame, int]:
    """Add ``__rb``: a deterministic range bucket of ``struct(sort_cols)``
    (ascending). Returns the frame and the number of buckets used.

    The bounds come from a row sample of about ``buckets *
    SAMPLE_PER_BUCKET`` keys; no task holds more than its share of it."""
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(sort_cols)])
    if buckets <= 1:
        return df.withColumn(_RB, F.lit(0)), 1
    keyed = df.select(key.alias("k"))
    total = keyed.count()
    rows = [r[0] for r in keyed.sample(False, min(1.0, min(MOST_SAMPLED, buckets * SAMPLE_PER_BUCKET) / max(1, total)), seed).sort("k").collect()]
    step = len(rows) / buckets
    cuts = []
    for i in range(1, buckets):
        if not rows:
            break
        v = rows[min(len(rows) - 1, int(i * step))]
        if not cuts or v != cuts[-1]:
            cuts.append(v)
    if not cuts:
        return df.withColumn(_RB, F.lit(0)), 1
    fields = keyed.schema["k"].dataType.fields
    bounds = F.array(*[_literal_struct(tuple(v), fields) for v in cuts])
    bucketed = df.withColumn(_KEY, key).withColumn(_RB, _bounds_below(F.col(_KEY), bounds, len(cuts)))
    return bucketed.drop(_KEY), len(cuts) + 1


def key_runs(df: DataFrame, key: list[str], runs: int, run_rows: int, lent_rows: int, out: str, seed: int = 17) -> tuple[DataFrame, list[int]]:
    """Cuts ``df`` into at most ``runs`` ranges of the ascending ``key``, of
    about ``run_rows`` rows if these are few. Returns the rows with the number
    of their range, ``out``, and how many rows are before each range, and in
    all. A range has ``lent_rows`` rows at least, but the last; its first, at
    least as many, are there once more for the range before.

    Two bounds a range are taken from a sample of the key: where it begins and
    where the rows end that it lends. The rows between bounds are then
    counted, so whatever the bounds, the numbers are exact. As few columns of
    the key give the bounds as tell its values apart almost as well as all."""
    total = df.count()
    runs = max(1, min(runs, MOST_BUCKETS, -(-total // run_rows)))
    rows, by = [], key
    if runs > 1:
        sampled = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
        rows = sampled.sample(False, min(1.0, min(MOST_SAMPLED, runs * SAMPLE_PER_BUCKET) / total), seed).sort(*sampled.columns).collect()
        different = len(set(rows))
        by = key[:next(n for n in range(1, len(key) + 1) if n == len(key) or len({r[:n] for r in rows}) >= 0.9 * different)]
    begin = {i * len(rows) // runs for i in range(1, runs)}
    lent = 1 + -(-2 * lent_rows * len(rows) // max(1, total))  # sampled rows between the bounds of a range, twice as many as needed
    cuts: list[tuple] = []
    begins = set()
    for at in sorted(begin | {x + lent for x in begin}):
        if at < len(rows):
            if not cuts or cuts[-1] != rows[at][:len(by)]:
                cuts.append(rows[at][:len(by)])
            if at in begin:
                begins.add(len(cuts))
    if not cuts:
        return df.withColumn(out, F.lit(0)), [0, total]
    kind = df.select(*by).schema.fields
    value = F.struct(*[F.col(c).alias(f.name) for c, f in zip(by, kind)])
    bounds = F.array(*[_literal_struct(v, kind) for v in cuts])
    bucketed = df.withColumn(_RB, _bounds_below(value, bounds, len(cuts)))
    counts = {r[_RB]: r["count"] for r in bucketed.groupBy(_RB).count().collect()}  # a row a bound
    counts = [counts.get(b, 0) for b in range(len(cuts) + 1)]
    own, also, before, have = [], [], [0], 0
    for b, n in enumerate(counts):
        if b in begins and have >= lent_rows and have:
            before.append(before[-1] + have)
            have = 0
        own.append(len(before) - 1)
        also.append(own[-1] - 1 if own[-1] and have < lent_rows else None)
        have += n
    place = lambda to: F.get(F.array(*[F.lit(x).cast("int") for x in to]), F.col(_RB))
    return bucketed.withColumn(out, F.explode(F.array_compact(F.array(place(own), place(also))))).drop(_RB), [*before, total]


def _direction_prefix(order: list[tuple[str, bool]]) -> tuple[list[str], bool]:
    """Longest prefix of the sort with one direction; True when descending."""
    first_desc = order[0][1]
    prefix = []
    for name, desc in order:
        if desc != first_desc:
            break
        prefix.append(name)
    return prefix, first_desc


def row_number(df: DataFrame, partition_by: list[str], order_by: list[tuple[str, bool]],
               out: str = "rn", buckets: int | None = None) -> DataFrame:
    """Exact ``row_number() OVER (PARTITION BY partition_by ORDER BY order_by)``
    (1-based) with no group and no table in a single task.

    ``order_by`` holds ``(column, descending)`` pairs. Descending sorts put
    nulls last, ascending nulls first, as Spark does by default. The order
    should be unique within a group, or ties are numbered arbitrarily.
    """
    buckets = buckets or _default_buckets(df.sparkSession)
    prefix, desc = _direction_prefix(order_by)
    # Any order of the groups works as long as each group's rows are
    # contiguous, so the groups take the direction of the sort prefix.
    bucket_cols = list(partition_by) + prefix
    bucketed, n = range_bucket(df, bucket_cols, buckets)
    if desc:
        bucketed = bucketed.withColumn(_RB, F.lit(n - 1) - F.col(_RB))

    sort = [F.col(c).desc() if d else F.col(c).asc() for c, d in order_by]
    w = Window.partitionBy(_RB, *partition_by).orderBy(*sort)
    local = bucketed.withColumn(_LRN, F.row_number().over(w))

    # Counts per (bucket, group), combined on the map side. This branch reads
    # only the sort and group columns (Spark prunes the rest); the bucket is a
    # pure function of the row, so both passes agree.
    counts = bucketed.groupBy(_RB, *partition_by).agg(F.count(F.lit(1)).alias(_CNT))
    w_off = Window.partitionBy(*partition_by).orderBy(_RB) \
        .rowsBetween(Window.unboundedPreceding, -1) if partition_by else \
        Window.orderBy(_RB).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(_OFF, F.coalesce(F.sum(_CNT).over(w_off), F.lit(0))) \
        .filter(F.col(_OFF) > 0).drop(_CNT)
    # At most one row per bucket boundary: bounded by the bucket count.
    offsets = F.broadcast(offsets.select(
        F.col(_RB).alias("__o_rb"), *[F.col(c).alias(f"__o_{i}") for i, c in enumerate(partition_by)],
        F.col(_OFF)))
    cond = F.col(_RB) == F.col("__o_rb")
    for i, c in enumerate(partition_by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__o_{i}"))
    joined = local.join(offsets, cond, "left")
    return joined.withColumn(out, (F.col(_LRN) + F.coalesce(F.col(_OFF), F.lit(0))).cast("long")) \
        .drop(_LRN, _OFF, _RB, "__o_rb", *[f"__o_{i}" for i in range(len(partition_by))])

