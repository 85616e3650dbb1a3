"""Chunked INSERT text (G3, W1) and object keys."""

from datetime import datetime

from pyspark.sql import functions as F

from tablekeep.functions import keys
from tablekeep.operators import chunks

from conftest import SF001


def test_chunk_of_two_format(spark):
    df = spark.createDataFrame([(1, "post", "publish"), (2, "page", "draft"), (3, "post", "x'y")],
                               "ID long, post_type string, post_status string")
    got = [r.value for r in chunks.insert_statements(df, "wp_posts", ["ID"], 2).orderBy("chunk_id").collect()]
    head = "INSERT INTO `wp_posts` (`ID`, `post_type`, `post_status`) VALUES\n"
    assert got == [head + "(1, 'post', 'publish'),\n(2, 'page', 'draft');\n", head + "(3, 'post', 'x\\'y');\n"]


def test_streaming_chunks_hold_every_row(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    recs = chunks.insert_records_streaming(o, "orders", 700).collect()
    tuples = [line for r in recs for line in r.value.split("\n")[1:-1]]
    assert len(tuples) == 15000
    assert all(len(r.value.split("\n")) - 2 <= 700 for r in recs)
    assert all(r.value.endswith(");\n") for r in recs)


def test_chunk_profile_exact(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    prof = chunks.chunk_profile(chunks.with_chunks(li, ["l_orderkey", "l_linenumber"], 1000)).collect()
    assert len(prof) == 60 and all(r.row_count == 1000 for r in prof)


def col(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_safe_name_is_bytewise(spark):
    assert col(spark, "wp db€", keys.safe_name) == "wp_db___"
    assert col(spark, "", keys.safe_name) == "database"
    assert col(spark, "a.b-c_d9", keys.safe_name) == "a.b-c_d9"


def test_prefix_and_key_normalise(spark):
    assert col(spark, " //site/x// ", keys.normalise_prefix) == "site/x"
    assert col(spark, "  /a/b ", keys.normalise_key) == "a/b"
    assert col(spark, '"abc"', keys.trim_etag) == "abc"


def test_backup_key(spark):
    df = spark.createDataFrame([("", ), ("/pre/",), ("0",)], "p string")
    ts = F.lit(datetime(2026, 8, 10, 3, 4, 5)).cast("timestamp_ntz")
    got = [r[0] for r in df.select(keys.backup_key(F.col("p"), F.lit("wp"), ts)).collect()]
    assert got == ["backups/database/2026/08/10/db-wp-20260810-030405.sql.gz",
                   "pre/backups/database/2026/08/10/db-wp-20260810-030405.sql.gz",
                   "0/backups/database/2026/08/10/db-wp-20260810-030405.sql.gz"]


def test_key_predicates(spark):
    rows = [("b", "site/backups/database/2026/db-x.sql.gz", True, True),
            ("b", "site/backups/database/2026/db-x.sql.gz/", True, True),
            ("b", "site/backups/database/2026/x.sql.gz", False, False),
            ("b", "x/site/backups/database/db-x.sql.gz", False, True),
            ("b", "backups/database/db-x.sql.gz", False, True),
            ("", "site/backups/database/db-x.sql.gz", True, False),
            ("b", "site/backups/database/DB-x.sql.gz", False, False)]
    df = spark.createDataFrame(rows, "bucket string, key string, f3 boolean, f4 boolean")
    out = df.select(keys.is_backup_key(F.col("key"), F.lit("/site/")).alias("a"), "f3",
                    keys.is_safe_key("bucket", "key").alias("b"), "f4").collect()
    assert all(r.a == r.f3 and r.b == r.f4 for r in out)


def test_chunks_of_wide_rows_end_at_a_byte_bound():
    import pyarrow as pa

    from tablekeep.operators.chunks import _chunk_batches
    rows = ["(" + "x" * n + ")" for n in (10, 500, 500, 10, 10, 900, 5, 5, 5, 5, 5, 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i:i + 5])], names=["tuple"]) for i in range(0, len(rows), 5)]
    for size in (4, 100):
        out = [v for b in _chunk_batches(size, "H\n", ";\n", max_bytes=1000)(iter(batches)) for v in b.column(0).to_pylist()]
        assert [t for v in out for t in v[2:-2].split(",\n")] == rows
        assert all(len(v) <= 1100 and v.count("(") <= size for v in out)


def test_chunks_leave_in_small_batches():
    import pyarrow as pa

    from tablekeep.operators.chunks import _chunk_batches
    rows = [f"({i}, '{'x' * 90}')" for i in range(10_000)]
    for cuts in ([0, 10_000], [0, 250, 9_990, 10_000]):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[s:e])], names=["tuple"]) for s, e in zip(cuts, cuts[1:])]
        out = list(_chunk_batches(300, "H\n", ";\n", batch_bytes=100_000)(iter(batches)))
        assert max(b.nbytes for b in out) < 150_000
        records = [v[2:-2].split(",\n") for b in out for v in b.column(0).to_pylist()]
        assert [len(r) for r in records] == [300] * 33 + [100] and [t for r in records for t in r] == rows
