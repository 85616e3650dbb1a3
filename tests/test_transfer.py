"""Single objects, executor listings, pinned views, digests and digest trees."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import digest, verify
from tablekeep.sources import dump, frontier, part_digests, single


def frame(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(i, f"line {i}\nof 'text' ({rng.random()})", rng.random(), [float(i), None], i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t string, d double, a array<double>, b boolean").repartition(5)


def bag(df):
    return sorted(map(str, df.collect()))


def folder_text(path):
    return b"".join(gzip.decompress(open(os.path.join(d, f), "rb").read())
                    for d, f in sorted((d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".gz")))


def test_single_object_is_the_dump_as_one_gzip_file(spark, tmp_root, monkeypatch):
    tables = {"one": frame(spark, 3000), "two": frame(spark, 10, 1), "none": frame(spark, 5).limit(0)}
    dump.write_dump(tables, f"{tmp_root}/d", "2024-01-01T00:00:00+00:00", size=50, max_records=10)
    text, size = folder_text(f"{tmp_root}/d"), single.compose(spark, f"{tmp_root}/d", f"{tmp_root}/out/db-x.sql.gz")
    assert os.path.getsize(f"{tmp_root}/out/db-x.sql.gz") == size and not os.path.exists(f"{tmp_root}/d")
    with gzip.open(f"{tmp_root}/out/db-x.sql.gz") as f:
        assert f.read() == text
    assert os.listdir(f"{tmp_root}/out") == ["db-x.sql.gz"] or sorted(x for x in os.listdir(f"{tmp_root}/out") if not x.startswith(".")) == ["db-x.sql.gz"]
    monkeypatch.setattr(single, "COPY_BYTES", 1000)  # pieces end anywhere
    back = single.read_object(spark, f"{tmp_root}/out/db-x.sql.gz")
    assert {n: bag(df) for n, df in back.items()} == {n: bag(df) for n, df in tables.items()}
    assert back["one"].schema == tables["one"].schema and back["one"].rdd.getNumPartitions() > 1
    with pytest.raises(FileExistsError):
        dump.write_dump(tables, f"{tmp_root}/d", "2024-01-01T00:00:00+00:00")
        single.compose(spark, f"{tmp_root}/d", f"{tmp_root}/out/db-x.sql.gz")


def test_member_index_of_any_length():
    for n in (0, 1, 500, 30_000):
        index = {"members": [{"table": f"t{i}", "offset": random.getrandbits(40), "bytes": i} for i in range(n)], "columns": []}
        body = single.index_members(index, 12345)
        assert gzip.decompress(body) == b""
    with pytest.raises(ValueError):
        single.payload_of(gzip.compress(b"x"))


def test_object_index_is_read_from_its_end(tmp_root):
    index = {"members": [{"table": "t", "offset": i, "bytes": random.getrandbits(50)} for i in range(20_000)], "columns": [{"a": 1}]}
    data = gzip.compress(b"some text")
    with open(f"{tmp_root}/o.gz", "wb") as f:
        f.write(data + single.index_members(index, len(data)))
    assert single.read_index(f"{tmp_root}/o.gz") == index
    assert gzip.open(f"{tmp_root}/o.gz").read() == b"some text"
    with open(f"{tmp_root}/plain.gz", "wb") as f:
        f.write(gzip.compress(os.urandom(500)))
    with pytest.raises(ValueError):
        single.read_index(f"{tmp_root}/plain.gz")


def test_listing_by_executors_finds_every_file(spark, tmp_root):
    want = set()
    for i in range(40):
        at = f"{tmp_root}/a/{i % 3}/{'deep/' * (i % 4)}f{i} ü"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write("x" * i)
        want.add((at, i))
    os.makedirs(f"{tmp_root}/a/empty/_hidden")
    open(f"{tmp_root}/a/empty/_hidden/x", "w").close()
    got = {("/" + r.path.split(":", 1)[-1].lstrip("/"), r.length) for r in frontier.list_files(spark, f"{tmp_root}/a").collect()}
    assert got == want
    assert len(frontier.list_files(spark, f"{tmp_root}/a", hidden=True).collect()) == 41
    assert frontier.list_files(spark, f"{tmp_root}/no-such").count() == 0


def test_pinned_view_keeps_the_old_rows(spark, tmp_root):
    frame(spark, 100).write.parquet(f"{tmp_root}/live/t.parquet")
    frame(spark, 7).coalesce(1).write.parquet(f"{tmp_root}/live/u.parquet")
    view = frontier.PinnedView(spark, f"{tmp_root}/live")
    assert view.table_names() == ["t", "u"]
    frame(spark, 50, 3).write.mode("append").parquet(f"{tmp_root}/live/t.parquet")
    assert bag(view.load("t")) == bag(frame(spark, 100)) and view.load("u").count() == 7
    # one pinned file replaced by another of the same name
    files = sorted(f for f in os.listdir(f"{tmp_root}/live/u.parquet") if f.endswith(".parquet"))
    frame(spark, 9).coalesce(1).write.parquet(f"{tmp_root}/other")
    new = next(f for f in os.listdir(f"{tmp_root}/other") if f.endswith(".parquet"))
    os.replace(f"{tmp_root}/other/{new}", f"{tmp_root}/live/u.parquet/{files[0]}")
    os.remove(f"{tmp_root}/live/u.parquet/.{files[0]}.crc")
    with pytest.raises(Exception, match="changed since it was pinned"):
        view.load("u").collect()
    pinned = view.manifest.filter("table_name = 't'").select("file").first().file
    os.remove(pinned)
    os.remove(os.path.join(os.path.dirname(pinned), f".{os.path.basename(pinned)}.crc"))
    with pytest.raises(FileNotFoundError):
        view.load("t")


def test_digests_add_and_name_damaged_parts(spark, tmp_root):
    df = frame(spark, 2000)
    dump.write_dump({"t": df}, f"{tmp_root}/d", "2024-01-01T00:00:00+00:00", size=20, max_records=10)
    part_digests.write_digests(spark, f"{tmp_root}/d")
    whole = digest.digest(df).first()
    assert tuple(part_digests.table_digests(spark, f"{tmp_root}/d").drop("dir").first()) == tuple(whole)
    parts = digest.digest(df.filter("k < 700")).unionByName(digest.digest(df.filter("k >= 700"))).withColumn("x", F.lit(1))
    assert tuple(digest.add(parts, ["x"]).drop("x").first()) == tuple(whole)
    assert tuple(digest.digest(df.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert {r.state for r in part_digests.check_parts(spark, f"{tmp_root}/d").collect()} == {"same"}
    files = sorted(os.path.join(p, f) for p, _, fs in os.walk(f"{tmp_root}/d") for f in fs if f.endswith(".gz") and "-t" in p)
    assert len(files) >= 4
    text = gzip.decompress(open(files[1], "rb").read())
    at = text.index(b"line ") + 5
    with open(files[1], "wb") as f:  # one byte of one value
        f.write(gzip.compress(text[:at] + bytes([text[at] ^ 1]) + text[at + 1:]))
    with open(files[2], "r+b") as f:  # cut off
        f.truncate(os.path.getsize(files[2]) // 2)
    os.remove(files[3])
    for crc in (files[1], files[2], files[3]):
        hidden = os.path.join(os.path.dirname(crc), f".{os.path.basename(crc)}.crc")
        if os.path.exists(hidden):
            os.remove(hidden)
    got = {r.part.split("/")[-1]: r.state for r in part_digests.check_parts(spark, f"{tmp_root}/d").filter("state <> 'same'").collect()}
    names = [os.path.basename(f) for f in files]
    assert got == {names[1]: "changed", names[2]: "changed", names[3]: "missing"} or got == {names[1]: "changed", names[2]: "missing", names[3]: "missing"}


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, v string").repartition(4)


@pytest.mark.parametrize("leaf", [0, 50])
def test_tree_finds_the_ranges_that_differ(spark, leaf):
    rng = random.Random(5)
    rows = [(rng.choice([i, i * 1_000_003, -i]), f"v{i}") for i in range(3000)] + [(None, "n"), (None, "n")]
    other = [(k, v) for k, v in rows if v not in ("v17", "v2900")] + [(5, "new"), (rows[40][0], "v40")]
    a, b = keyed(spark, rows), keyed(spark, other)
    want = {r.k for r in verify.diff_rows(a, b, "exceptall").collect()}
    got = digest.diff_ranges(a, b, "k", leaf_rows=leaf).collect()
    assert all(any(r.low <= k <= r.high for r in got) for k in want) and len(got) <= len(want)
    if leaf == 0:
        assert {r.low for r in got} == {r.high for r in got} == want
    for r in got:
        inside = lambda rs: sum(k is not None and r.low <= k <= r.high for k, _ in rs)  # noqa: B023, E731
        assert (r.source_count, r.restore_count) == (inside(rows), inside(other))


def test_tree_of_equal_empty_and_wholly_different_tables(spark):
    rows = [(i, str(i)) for i in range(500)]
    a = keyed(spark, rows)
    assert digest.diff_ranges(a, keyed(spark, rows), "k").count() == 0
    assert digest.diff_ranges(a.limit(0), a.limit(0), "k").count() == 0
    got = digest.diff_ranges(a, a.limit(0), "k", leaf_rows=0, most_ranges=10).collect()  # wider ranges beyond the bound
    assert len(got) <= 10 and sum(r.source_count for r in got) == 500
    nulls = keyed(spark, [(None, "x")])
    assert [tuple(r) for r in digest.diff_ranges(a.unionByName(nulls), a, "k").collect()] == [(None, None, 1, 0)]


def test_tree_hashes_every_row_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(digest, "row_lanes", lambda *a, _f=digest.row_lanes: made.append(1) or _f(*a))
    a = keyed(spark, [(i, "a") for i in range(5000)])
    b = keyed(spark, [(i, "b" if i % 1700 == 3 else "a") for i in range(5000)])
    got = digest.diff_ranges(a, b, "k", leaf_rows=0).collect()
    assert sorted(r.low for r in got) == [3, 1703, 3403] and len(made) == 2  # one side each, for all levels
