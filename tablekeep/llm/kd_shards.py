"""Sharding by a K-d tree over document metadata, sizes near equal.

Every document is a point: source, language, length and id as numbers, heavy
by the bytes of its text and a fixed overhead. The tree starts with all points
and as many shares as there are shards; a node with several shares is cut along
its widest dimension (its extent as a part of the whole extent) at the weighted
quantile that leaves whole shares on both sides, the median where they are
even, until a node has one share and its bytes are the target.

Documents with equal texts are one group. They stand at the place of the
group's smallest row and stay together, unless the group weighs more than
``GROUP_PART`` of a shard; then its rows are cut like others. Points equal in
the dimension that is cut are ordered by text hash, then within a large group by
id.

The quantile of all nodes of a level is found at once: each pass sums weights
in equal bins of what is left of a node's range (map-side combine, at most
``2 ** BIN_BITS`` rows a node), and the bin that holds the quantile is the range of the
next pass, until it is light, or one value; then the next part of the key is
cut. The driver holds the cuts, one per shard; the passes read a table of a few
numbers per document, never texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

OVERHEAD = 16
#: Groups of equal texts up to this part of a shard's bytes are kept together.
GROUP_PART = 0.01
#: A bin this light, as a part of a shard's bytes, is not cut further.
FINE_PART = 0.0005
BIN_BITS = 12
#: Trees of more nodes than this are joined by shuffle, not broadcast.
BROADCAST_NODES = 100_000
#: Rows of one shard that are numbered in one task.
SLOT_ROWS = 50_000


def prefix_number(text: Column) -> Column:
    """The first seven bytes of a text as a number, in byte order; 0 for null."""
    first = F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 1, 7)), 14, "0")
    return F.conv(first, 16, 10).cast("long")


def points(docs: DataFrame) -> DataFrame:
    """One row per different (id, text, source, language) with ``n``, how many
    rows it stands for: ``doc_id, size, crc, h1, h2`` (text hashes) and the
    dimensions ``d0`` to ``d3``, not negative."""
    text = F.coalesce(F.col("text"), F.lit(""))
    column = lambda name: F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("crc"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("h1"),
        F.hash(text).alias("h2"), prefix_number(column("source")).alias("d0"), prefix_number(column("lang")).alias("d1"),
        (F.log2(F.octet_length(text) + 1.0) * (1 << 20)).cast("long").alias("d2"),
        # a quarter of the id, lifted above zero; a null id is the smallest
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 2) + F.lit(1 << 61), F.lit(0)).alias("d3"))
    return rows.groupBy("doc_id", "size", "crc", "h1", "h2", "d0", "d1", "d2", "d3").agg(F.count(F.lit(1)).alias("n"))


def keyed(rows: DataFrame, shard_bytes: float) -> DataFrame:
    """Rows with the place of their group, ``t`` (0, or for a large group a
    hash that tells its rows apart) and ``m``, the copies a row stands for: a
    row whose copies are heavy becomes several."""
    group = ["h1", "h2", "crc", "size"]
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "d0", "d1", "d2", "d3")
    groups = (rows.groupBy(*group).agg(F.min(place).alias("first"), F.sum(F.col("n").cast("double") * F.col("size")).alias("weight"))
              .select(*[F.col(c).alias(f"_{c}") for c in group], "first", "weight"))
    match = F.lit(True)
    for c in group:
        match = match & (F.col(c) == F.col(f"_{c}"))
    large = F.col("weight") > GROUP_PART * shard_bytes
    most = F.greatest(F.lit(1), F.floor(F.lit(FINE_PART * shard_bytes) / F.col("size"))).cast("long")
    pieces = F.when(large, F.ceil(F.col("n") / most)).otherwise(F.lit(1)).cast("long")
    out = rows.join(groups, match).withColumn("most", most).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    copies = F.when(large, F.least(F.col("most"), F.col("n") - F.col("piece") * F.col("most"))).otherwise(F.col("n"))
    tell = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "d0", "d1"), 2)
    return out.select("doc_id", "size", "crc", "h1", "piece", *[F.col(f"first.d{i}").alias(f"d{i}") for i in range(4)],
                      F.when(large, tell).otherwise(F.lit(0)).cast("long").alias("t"), copies.cast("long").alias("m"))


@dataclass(frozen=True)
class Node:
    """A node of one level: its first shard, which names it, how many it has, its weight, and the search for its
    cut. ``key`` holds the parts of the cut that are settled, [low, low + 2 **
    bits) the range the next part is in, ``base`` the weight below it."""

    first: int
    shares: int
    weight: int = 0
    dim: int = 0
    key: tuple = ()
    low: int = 0
    bits: int = 0
    base: int = 0
    cut: tuple | None = None

    @property
    def left(self) -> int:
        return self.shares // 2

    @property
    def target(self) -> float:
        return self.weight * self.left / self.shares


def _with_nodes(table: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """Join of small rows per node (``_node`` first); there are no more nodes
    than shards."""
    small = table.sparkSession.createDataFrame(values, schema)
    if len(values) <= BROADCAST_NODES:
        small = F.broadcast(small)
    return table.join(small, F.col("node") == F.col("_node"), "left")


def _extents(table: DataFrame) -> dict[int, tuple]:
    sums = table.groupBy("node").agg(F.sum(F.col("m") * F.col("size")).alias("w"), *[f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(4) for f in (F.min, F.max)])
    return {r["node"]: (r["w"], [(r[f"min{i}"], r[f"max{i}"]) for i in range(4)]) for r in sums.collect()}


def _pick(d: str) -> Column:
    return F.when(F.col(d) == 0, F.col("d0")).when(F.col(d) == 1, F.col("d1")).when(F.col(d) == 2, F.col("d2")).otherwise(F.col("d3"))


def _pass(table: DataFrame, nodes: list[Node]) -> dict[int, tuple]:
    """For each node the bin that holds its quantile: ``(bin, weight below it
    in the range, its weight, least and largest value of each part of the key
    in it)``."""
    rows = [(x.first, x.dim, len(x.key), *(list(x.key) + [0, 0])[:2], x.low, min(x.low + (1 << x.bits), 1 << 63) - 1, max(0, x.bits - BIN_BITS), float(x.target - x.base))
            for x in nodes]
    joined = _with_nodes(table, rows, "_node int, _dim int, _part int, _k0 long, _k1 long, _low long, _high long, _shift int, _want double")
    joined = joined.filter("_node is not null").withColumn("p0", _pick("_dim"))
    value = F.when(F.col("_part") == 0, F.col("p0")).when(F.col("_part") == 1, F.col("h1")).otherwise(F.col("t"))
    inside = joined.filter(((F.col("_part") == 0) | (F.col("p0") == F.col("_k0"))) & ((F.col("_part") < 2) | (F.col("h1") == F.col("_k1")))
                           & value.between(F.col("_low"), F.col("_high")))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("p0", "h1", "t") for f in (F.min, F.max)]
    bins = (inside.withColumn("w", F.expr("m * size")).withColumn("bin", F.call_function("shiftright", value - F.col("_low"), F.col("_shift")))
            .groupBy("node", "_want", "bin").agg(F.sum("w").alias("w"), *ends))
    before = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) - F.col("w")
    # at most 2 ** BIN_BITS rows a node
    bin_row = F.struct("bin", "before", "w", *[f"{f}_{c}" for c in ("p0", "h1", "t") for f in ("min", "max")])
    found = bins.withColumn("before", before).filter("before <= _want").groupBy("node").agg(F.max(bin_row).alias("b"))
    return {r["node"]: tuple(r["b"]) for r in found.collect()}


def _narrowed(x: Node, found: tuple, fine: float) -> Node:
    """The node after a pass: its cut (points below it go left) if the bin is
    light or holds one point, or the range of what the bin holds."""
    at, before, weight, *ends = found
    ends = list(zip(ends[::2], ends[1::2]))
    base, shift, part = x.base + before, max(0, x.bits - BIN_BITS), len(x.key)
    wide = [i for i in range(part, 3) if ends[i][0] < ends[i][1]]
    if weight > fine and wide:
        low, high = ends[wide[0]]
        return replace(x, key=(*x.key, *[ends[i][0] for i in range(part, wide[0])]), low=low, bits=(high - low).bit_length(), base=base)
    after = x.target - base > base + weight - x.target  # the nearer side of the bin
    return replace(x, cut=(*x.key, x.low + ((at + after) << shift), 0, 0)[:3])


def _cut_level(table: DataFrame, nodes: list[Node], fine: float) -> list[Node]:
    done: list[Node] = []
    while nodes:
        found = _pass(table, nodes)
        nodes = [_narrowed(x, found[x.first], fine) for x in nodes]
        done += [x for x in nodes if x.cut]
        nodes = [x for x in nodes if not x.cut]
    return done


def tree(rows: DataFrame, shards: int, fine: float) -> DataFrame:
    """``rows`` with ``node``: the shard of each point."""
    table = common.stage(rows.withColumn("node", F.lit(0)), "kd-points")
    nodes = [Node(0, shards)]
    whole: list | None = None
    while any(x.shares > 1 for x in nodes):
        extents = _extents(table)
        if not extents:
            break
        whole = whole or [max(1, high - low) for low, high in extents[0][1]]
        work = []
        for x in nodes:
            if x.shares > 1 and x.first in extents:
                weight, sides = extents[x.first]
                dim = max(range(4), key=lambda i: (sides[i][1] - sides[i][0]) / whole[i])
                low, high = sides[dim]
                work.append(replace(x, weight=weight, dim=dim, low=low, bits=max(1, (high - low).bit_length())))
        cuts = [(x.first, x.dim, *x.cut, x.first + x.left) for x in _cut_level(table, work, fine)]
        joined = _with_nodes(table, cuts, "_node int, _dim int, _k0 long, _k1 long, _k2 long, _right int")
        value = _pick("_dim")
        below = (value < F.col("_k0")) | ((value == F.col("_k0")) & ((F.col("h1") < F.col("_k1")) | ((F.col("h1") == F.col("_k1")) & (F.col("t") < F.col("_k2")))))
        moved = joined.withColumn("node", F.when(F.col("_right").isNull() | below, F.col("node")).otherwise(F.col("_right")))
        table = common.stage(moved.select(*table.columns), "kd-points")
        # a node is named by its first shard, so a leaf's name is its shard
        nodes = [y for x in nodes for y in ([x] if x.shares == 1 else [Node(x.first, x.left), Node(x.first + x.left, x.shares - x.left)])]
    return table


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``(doc_id, size, crc, h1, shard, slot)``, one row per row of ``docs``:
    its shard from 0, and its place in it, from 0 without gaps.

    ``shards``, or the number that makes them ``target_bytes`` each. Null and
    empty texts weigh the overhead; a null id is the smallest; rows equal in
    id, text, source and language get slots of their own; missing ``source`` or
    ``lang`` columns count as null, further columns are ignored. An empty table
    gives an empty result; with fewer rows than shards some shards stay empty.
    """
    rows = common.stage(points(docs), "kd-rows")
    total = rows.agg(F.sum(F.col("n") * F.col("size").cast("decimal(20,0)"))).first()[0]
    total = int(total or 0)
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    placed = tree(keyed(rows, total / shards), shards, FINE_PART * total / shards)
    placed = placed.withColumnRenamed("node", "shard")
    # slots: rows of a shard dealt to pieces by hash, numbered in each after those before it
    pieces = max(1, math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / shards / SLOT_ROWS))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("h1", "doc_id", "piece"), F.lit(pieces)).cast("int"))
    slots = common.running_sum(dealt, ["shard"], "part", ["h1", "doc_id", "piece", "size", "crc", "m"], "m", "slot")
    return (slots.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
            .select("doc_id", "size", "crc", "h1", "shard", (F.col("slot") + F.col("copy")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``(doc_id, text, shard, slot)`` ready to be written by shard: every row's
    text at its place. Texts are matched by id, size and two hashes; a text
    that several rows share is fetched once."""
    places = assign(docs, shards, target_bytes)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("_h"),
                        F.crc32(F.encode(text, "utf-8")).alias("_c"), "text").groupBy("_d", "_h", "_c").agg(F.max("text").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_h")) & (F.col("crc") == F.col("_c"))
    return places.join(texts, same, "left").select("doc_id", "text", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` under the
    law ``bytes``: shards of near equal size."""
    return assign(docs, shards).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                                       F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                                       F.lit(None).cast("int").alias("grown_shard"))
