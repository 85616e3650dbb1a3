"""Centroid clustering with heap-ordered bounds.

Lloyd's rounds over whole-number vectors, exact in every step. A vector that
was scanned keeps its gap: distance to the second nearest centroid minus
distance to its own. When centroids move, the gap of a vector of cluster c
shrinks by at most c's own step plus the longest step of another centroid; the
sum of these since the start is c's accumulated drift. Each cluster keeps its
vectors in a heap by gap plus the drift at their scan, so those whose gap has
expired are exactly the ones whose key is not above the drift now: only they
are popped, scanned against all centroids and pushed again, the rest keep
their centroid without being looked at.

Vectors are packed into blocks of at most ``BLOCK``. A block has one row in a
table of vectors, written once, and one in the table of heaps of a round. Both
tables are bucketed by block, so their join moves no data. A heap is a run of
row numbers in ascending order of key, which is a valid heap whose expired part
is a prefix. What a block changes in the sums of the clusters is added up by
Spark; the driver gets one number per cluster and dimension.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.session import remove_path, scratch_path, ship_package

from . import common, vectors

BLOCK = 4096
_HEAPS = "block long, owner binary, key binary, heap binary, sizes binary, moved array<long>"


@dataclass
class Centroids:
    """Centroids (whole numbers), their exact sums and counts, and each
    cluster's accumulated drift."""

    at: np.ndarray
    sums: list[list[int]] = field(default_factory=list)
    drift: np.ndarray | None = None

    def __post_init__(self) -> None:
        k, dims = self.at.shape
        self.sums = self.sums or [[0] * (dims + 1) for _ in range(k)]
        self.drift = np.zeros(k) if self.drift is None else self.drift

    def step(self, moved: dict[int, int]) -> bool:
        """Add the changes of the sums (the last of each cluster is its count)
        and move every centroid that has vectors to the floor of their mean.
        False if none moved."""
        k, dims = self.at.shape
        for pos, value in moved.items():
            self.sums[pos // (dims + 1)][pos % (dims + 1)] += value
        before, self.at = self.at, self.at.copy()
        for c, (*total, n) in enumerate(self.sums):
            if n:
                self.at[c] = [s // n for s in total]
        # a little more than the true steps, so rounding never hides an expired gap
        steps = np.sqrt(((self.at - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        others = np.array([max(np.delete(steps, c), default=0.0) for c in range(k)])
        self.drift = self.drift + steps + others
        return bool(steps.any())

    def digest(self, c: int) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.at[c]).encode()).hexdigest()


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances. Doubles hold them where all partial sums stay
    below 2^53; else they are done in 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def rescan(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number) and its heap key."""
    d = squared_distances(x, centroids.at)
    owner = d.argmin(axis=1)
    if d.shape[1] == 1:
        return owner, np.full(len(x), np.inf)
    nearest, second = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)).T
    return owner, second - nearest - 1e-9 * (1 + second) + centroids.drift[owner]


class Heaps:
    """The heaps of one block: ``owner`` and ``key`` per row, ``heap`` the rows
    of cluster 0 in ascending order of key, then those of cluster 1, and so on,
    ``sizes`` how many each has."""

    def __init__(self, n: int, k: int) -> None:
        self.owner, self.key = np.full(n, -1, np.int16), np.zeros(n)
        self.heap, self.sizes = np.zeros(0, np.int32), np.zeros(k, np.int64)

    @classmethod
    def packed(cls, owner: bytes, key: bytes, heap: bytes, sizes: bytes) -> Heaps:
        out = cls(0, 0)
        out.owner, out.key = np.frombuffer(owner, np.int16).copy(), np.frombuffer(key, np.float64).copy()
        out.heap, out.sizes = np.frombuffer(heap, np.int32), np.frombuffer(sizes, np.int64)
        return out

    def pack(self) -> list[bytes]:
        return [self.owner.tobytes(), self.key.tobytes(), self.heap.tobytes(), self.sizes.tobytes()]

    def advance(self, x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, int]:
        """Pop the rows whose gap has expired, scan them and push them again.
        Returns the changes of the clusters' sums and counts, and how many
        rows were popped."""
        k, dims = centroids.at.shape
        if len(self.heap):
            runs = np.split(self.heap, np.cumsum(self.sizes)[:-1])
            cuts = [int(np.searchsorted(self.key[run], centroids.drift[c], side="right")) for c, run in enumerate(runs)]
            popped = np.concatenate([run[:cut] for run, cut in zip(runs, cuts)])
            rest = [run[cut:] for run, cut in zip(runs, cuts)]
        else:
            popped, rest = np.arange(len(x), dtype=np.int32), [np.zeros(0, np.int32)] * k
        owner, key = rescan(x[popped], centroids)
        before = self.owner[popped]
        self.owner[popped], self.key[popped] = owner, key
        runs, moved = [], np.zeros((k, dims + 1), np.int64)
        for c in range(k):
            run = np.concatenate([rest[c], popped[owner == c]])
            runs.append(run[np.argsort(self.key[run], kind="stable")])  # merges two ordered runs
            into, out_of = popped[(owner == c) & (before != c)], popped[(owner != c) & (before == c)]
            moved[c, :dims] = x[into].sum(axis=0) - x[out_of].sum(axis=0)
            moved[c, dims] = len(into) - len(out_of)
        self.heap, self.sizes = np.concatenate(runs).astype(np.int32), np.array([len(run) for run in runs])
        return moved, len(popped)


def _pack_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """``(block, ids, data)``: runs of at most ``BLOCK`` vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([vectors.whole(piece.column(1), dims).astype(np.int32).tobytes()], pa.binary())], names=["block", "ids", "data"])
                block += 1
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "block long, ids array<long>, data binary")


class _Bucketed:
    """A table bucketed by block under the shared folder."""

    def __init__(self, df: DataFrame, buckets: int, name: str) -> None:
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        self.table = f"tablekeep_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, "block").sortBy("block").option("path", self.path).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_path(self.spark, self.path)


def _advanced(joined: DataFrame, centroids: Centroids) -> DataFrame:
    """The heaps after the rows of ``joined(block, data[, owner, key, heap,
    sizes])`` met the centroids."""
    k, dims = centroids.at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, *state in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64)
                heaps = Heaps.packed(*state) if state else Heaps(len(x), k)
                moved, popped = heaps.advance(x, centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *[pa.array([b], pa.binary()) for b in heaps.pack()],
                     pa.array([[*moved.reshape(-1).tolist(), popped]], pa.list_(pa.int64()))],
                    names=["block", "owner", "key", "heap", "sizes", "moved"])
    return joined.mapInArrow(run, _HEAPS)


def _assigned(joined: DataFrame, centroids: Centroids) -> DataFrame:
    """``(id, cluster, distance)`` after a last pop of the heaps."""
    k, dims = centroids.at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ids, *state in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64)
                heaps = Heaps.packed(*state)
                heaps.advance(x, centroids)
                distance = ((x - centroids.at[heaps.owner]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(heaps.owner.astype(np.int32)), pa.array(distance)],
                                                 names=["id", "cluster", "distance"])
    return joined.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<id>``; ties (equal
    ids) by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    ints = F.transform("vector", lambda v: F.floor(v * vectors.SCALE))
    got = rows.select(order.alias("h"), ints.alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in got], np.int64)


@dataclass
class Clustering:
    """``assigned(id, cluster, distance)``, the final centroids, and how many
    vectors each round popped."""

    assigned: DataFrame
    centroids: Centroids
    popped: list[int]


def cluster(df: DataFrame, id_col: str, vector_col: str, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> Clustering | None:
    """Lloyd's ``rounds`` over the vectors of exactly ``dims`` finite entries,
    scaled to whole numbers, then one more assignment. None if there is no
    such vector; fewer than ``k`` make as many clusters. Rows with other
    vectors are dropped, repeated rows count each, null ids stay null, other
    columns are ignored."""
    spark: SparkSession = df.sparkSession
    rows = vectors.usable(df, id_col, vector_col, dims)
    at = first_centroids(rows, k, seed)
    if not len(at):
        return None
    now, popped = Centroids(at), []
    buckets = common.shuffle_partitions(spark)
    data = _Bucketed(_pack_blocks(rows, dims).repartition(buckets, "block"), buckets, "kmeans-vectors")
    joined, heaps = data.read().select("block", "data"), None
    for _ in range(rounds):
        done, heaps = heaps, _Bucketed(_advanced(joined, now), buckets, "kmeans-heaps")
        if done:
            done.drop()
        table = heaps.read()
        sums = (table.select(F.posexplode("moved").alias("pos", "v")).groupBy("pos")
                .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
        moved = {r["pos"]: int(r["v"]) for r in sums}
        popped.append(moved.pop(len(at) * (dims + 1)))
        moves = now.step(moved)
        joined = data.read().join(table, "block").select("block", "data", "owner", "key", "heap", "sizes")
        if not moves:  # further rounds change nothing
            break
    if heaps is None:  # no rounds: all rows are new to the heaps
        heaps = _Bucketed(_advanced(joined, now), buckets, "kmeans-heaps")
    last = data.read().join(heaps.read(), "block").select("data", "ids", "owner", "key", "heap", "sizes")
    out = common.stage(_assigned(last, now), "kmeans-assigned")
    heaps.drop()
    data.drop()
    return Clustering(out, now, popped)


def cluster_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256)`` of every vector that takes part (see ``cluster``); an
    empty result if none does."""
    spark = df.sparkSession
    found = cluster(df, id_col, vector_col)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = {r["cluster"]: int(r["s"]) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = spark.createDataFrame([(c, s, sum(sums.values()), found.centroids.digest(c)) for c, s in sorted(sums.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # facts has at most k rows
    return (found.assigned.join(F.broadcast(facts), "cluster")
            .select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def report_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The same by plain rounds over all vectors, in DuckDB."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept
  ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS near FROM (
    SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i})
  GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
    SELECT near.c AS c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, {dims + 1}) t(j) GROUP BY near.c, j)
  GROUP BY c)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
  CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = near.c"""
