"""A dump in key order: its part files in path order hold the rows in order."""

import glob
import gzip

from tablekeep.operators import chunks
from tablekeep.sources import dump


def test_part_files_follow_the_key(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(chunks, "RUN_CHUNKS", 2)
    plans, write = [], dump._write_text
    monkeypatch.setattr(dump, "_write_text", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    rows = spark.range(0, 4007, 1, 4).selectExpr("(id * 7919) % 4007 as k", "'it''s' as v")
    dump.write_dump({"t": rows}, f"{tmp_root}/d", "2024-01-01T00:00:00+00:00", size=50, keys={"t": ["k"]})
    files = sorted(glob.glob(f"{tmp_root}/d/000001-t/*.gz"))
    text = "".join(gzip.open(f, "rt").read() for f in files)
    assert len(files) > 4 and [int(x[1:x.index(",")]) for x in text.split("\n") if x.startswith("(")] == list(range(4007))
    assert text.count("INSERT INTO") == 81 and max(p.count("Exchange") for p in plans) == 1
