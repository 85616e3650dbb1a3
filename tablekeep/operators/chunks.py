"""Chunks of rows and the multi-row INSERT statements built from them.

Two ways to cut a table into chunks of at most ``size`` rows:

- exact: chunk ``i`` holds rows ``i*size+1 .. (i+1)*size`` of the key order,
  as consecutive LIMIT/OFFSET pages would. Row numbers alone come from
  ``ranking.row_number`` (range buckets, no one-task window); statements are
  made of sorted ranges of the key after one shuffle.
- streaming: consecutive rows of each input partition, in scan order, with no
  shuffle at all. This is the export default: the reference's page order is
  undefined anyway, every chunk still holds at most ``size`` rows, and a
  100 TB export then reads, renders and writes in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.literals import EXACT, Dialect, literal, quote_identifier_text, row_tuple
from . import ranking

RUN_CHUNKS = 16  # consecutive chunks of a task, at least, where the order of part files counts


def with_chunks(df: DataFrame, key: list[str], size: int = K.DEFAULT_CHUNK_ROWS,
                buckets: int | None = None) -> DataFrame:
    """W1 (exact): add ``rn`` (1-based, key order) and ``chunk_id``."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    ranked = ranking.row_number(df, [], [(k, False) for k in key], out="rn", buckets=buckets)
    return ranked.withColumn("chunk_id", F.floor((F.col("rn") - 1) / F.lit(size)).cast("long"))


def chunk_profile(chunked: DataFrame) -> DataFrame:
    """Rows per chunk (the chunk count and total follow from it)."""
    return chunked.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("row_count"))


def insert_header(table: str, schema: T.StructType) -> str:
    cols = ", ".join(quote_identifier_text(f.name) for f in schema.fields)
    return f"INSERT INTO {quote_identifier_text(table)} ({cols}) VALUES"


def _in_full(field: T.StructField) -> Column:
    """What rows equal in a key are told apart by: columns in which equal
    values have equal texts, texts of others (zeros have signs, maps no order)."""
    plain = (T.StringType, T.IntegralType, T.DecimalType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.col(quote_identifier_text(field.name)) if isinstance(field.dataType, plain) else literal(field)


def _run_chunks(before: list[int], size: int, prefix: str, suffix: str, batch_bytes: int = 4 << 20):
    """mapInArrow body: the statements ``chunk_id, value`` of the chunks that
    begin in a run, from its rows ``(__run, tuple)`` in order and the first of
    the next run. ``before[r]`` rows are before run r."""
    sep = K.INSERT_TUPLE_SEPARATOR

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def emit(chunks):
            ids, tuples = [c for c, _ in chunks], [t for _, t in chunks]
            ends = [0]
            for t in tuples:
                ends.append(ends[-1] + len(t))
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.concat_arrays(tuples))
            joined = pc.binary_join(lists, pa.scalar(sep, pa.large_string()))
            texts = pc.binary_join_element_wise(pa.scalar(prefix, pa.large_string()), joined, pa.scalar(suffix, pa.large_string()),
                                                pa.scalar("", pa.large_string()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), texts.cast(pa.string())], names=["chunk_id", "value"])
        skip = left = chunk = None
        part: list = []  # of the chunk begun
        part_rows, ready, ready_bytes = 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if skip is None:
                r = batch.column(0)[0].as_py()
                first, stop = (min(before[-1], -(-n // size) * size) for n in before[r:r + 2])
                skip, left, chunk = first - before[r], max(0, stop - first), first // size
            rows = batch.column(1)
            passed = min(skip, len(rows))
            skip -= passed
            rows = rows.slice(passed, left)
            left -= len(rows)
            at = 0
            while at < len(rows):
                some = rows.slice(at, size - part_rows).cast(pa.large_string())
                at += len(some)
                part_rows += len(some)
                part.append(some)
                if part_rows == size:
                    ready.append((chunk, pa.concat_arrays(part)))
                    ready_bytes += ready[-1][1].nbytes
                    part, part_rows, chunk = [], 0, chunk + 1
                    if ready_bytes > batch_bytes:
                        yield emit(ready)
                        ready, ready_bytes = [], 0
            # the rest is copied, so it does not hold the whole batch
            part = [pa.concat_arrays([*part, pa.array([], pa.large_string())])] if part_rows else []
        if part_rows:
            ready.append((chunk, pa.concat_arrays(part)))
        if ready:
            yield emit(ready)
        pa.default_memory_pool().release_unused()  # idle workers live on

    return run


def insert_statements(df: DataFrame, table: str, key: list[str], size: int = K.DEFAULT_CHUNK_ROWS,
                      dialect: Dialect = EXACT, buckets: int | None = None, ordered: bool = False) -> DataFrame:
    """G3 + C7 (exact): ``chunk_id, value`` with one INSERT per chunk, in key
    order within a task. The rows pass one shuffle, as they are: each task gets
    a range of the key and the rows that complete its last chunk from the next
    range, sorts them and joins the texts of consecutive rows. Row numbers
    follow from the rows before a range, which are counted. There are
    ``buckets`` tasks at most, their order is that of the chunks (``ordered``
    or not)."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    runs = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [quote_identifier_text(k) for k in key]
    placed, before = ranking.key_runs(df, keys, runs, RUN_CHUNKS * size, size, "__run")
    order = [F.col(k).asc() for k in keys] + [_in_full(f).asc() for f in df.schema.fields]
    rows = placed.repartitionById(len(before) - 1, "__run").sortWithinPartitions(*order)
    return (rows.select("__run", row_tuple(df.schema, dialect).alias("tuple"))
            .mapInArrow(_run_chunks(before, size, insert_header(table, df.schema) + "\n", ";\n"), "chunk_id long, value string"))


def _chunk_batches(size: int, prefix: str, suffix: str, max_bytes: int = 512 << 20, batch_bytes: int = 4 << 20):
    """mapInArrow body: join consecutive tuple texts of one partition into
    records of ``size`` tuples with pyarrow compute (no per-row Python).
    Records leave in batches of about ``batch_bytes``, since joining copies a
    batch several times. The closure holds plain values only, so executors
    need only pyarrow."""
    sep = K.INSERT_TUPLE_SEPARATOR

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pending: list = []
        pending_rows = 0

        def emit(arr):
            n = len(arr)
            if n == 0:
                return
            arr = arr.cast(pa.large_string())
            # a chunk ends after ``size`` rows, or earlier at ``max_bytes``
            lens = pc.binary_length(arr)
            starts = []
            for c in range(0, n, size):
                starts.append(c)
                part = lens.slice(c, min(size, n - c))
                if (pc.sum(part).as_py() or 0) > max_bytes:
                    acc = 0
                    for i, b in enumerate(part.to_pylist()):
                        if acc and acc + (b or 0) > max_bytes:
                            starts.append(c + i)
                            acc = 0
                        acc += b or 0
            starts.append(n)
            # group records into small output batches
            group_start = 0
            acc = 0
            bounds = []
            for i in range(len(starts) - 1):
                chunk_bytes = pc.sum(lens.slice(starts[i], starts[i + 1] - starts[i])).as_py() or 0
                if acc and acc + chunk_bytes > batch_bytes:
                    bounds.append((group_start, i))
                    group_start, acc = i, 0
                acc += chunk_bytes
            bounds.append((group_start, len(starts) - 1))
            for g0, g1 in bounds:
                lo, hi = starts[g0], starts[g1]
                part = arr.slice(lo, hi - lo)
                offs = pa.array([s - lo for s in starts[g0:g1 + 1]], pa.int64())
                lists = pa.LargeListArray.from_arrays(offs, part)
                joined = pc.binary_join(lists, pa.scalar(sep, pa.large_string()))
                rec = pc.binary_join_element_wise(pa.scalar(prefix, pa.large_string()), joined,
                                                  pa.scalar(suffix, pa.large_string()),
                                                  pa.scalar("", pa.large_string()))
                # a batch is under max_bytes, or one record of little more, so 32-bit offsets suffice
                yield pa.RecordBatch.from_arrays([rec.cast(pa.string())], names=["value"])

        for batch in batches:
            col = batch.column(0)
            if len(col) == 0:
                continue
            pending.append(col)
            pending_rows += len(col)
            if pending_rows < size and sum(c.nbytes for c in pending) > max_bytes:
                yield from emit(pa.concat_arrays([c.cast(pa.large_string()) for c in pending]))
                pending, pending_rows = [], 0
            if pending_rows >= size:
                first = size - (pending_rows - len(col))  # rows that fill the chunk begun before this batch
                if first < size:
                    yield from emit(pa.concat_arrays([c.cast(pa.large_string()) for c in [*pending[:-1], col.slice(0, first)]]))
                else:
                    first = 0
                cut = first + (len(col) - first) // size * size
                yield from emit(col.slice(first, cut - first))
                # the rest is copied, so it does not hold the whole batch
                pending = [pa.concat_arrays([col.slice(cut).cast(pa.large_string()), pa.array([], pa.large_string())])] if cut < len(col) else []
                pending_rows = len(col) - cut
        if pending_rows:
            yield from emit(pa.concat_arrays([c.cast(pa.large_string()) for c in pending]))
        pa.default_memory_pool().release_unused()  # idle workers live on

    return run


def insert_records_streaming(df: DataFrame, table: str, size: int = K.DEFAULT_CHUNK_ROWS,
                             dialect: Dialect = EXACT) -> DataFrame:
    """G3 + C7 (streaming): ``value`` records, one INSERT per run of ``size``
    consecutive rows of a partition. No shuffle; the tuple text is rendered in
    the JVM and only joined in Arrow batches."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    header = insert_header(table, df.schema)
    tuples = df.select(row_tuple(df.schema, dialect).alias("tuple"))
    return tuples.mapInArrow(_chunk_batches(size, header + "\n", ";\n"), "value string")
