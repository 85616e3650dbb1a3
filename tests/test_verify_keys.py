"""Rows are compared by the bytes of their fingerprints; results show hex."""

from tablekeep.functions.hashing import row_fingerprint
from tablekeep.operators import verify


def test_rows_are_counted_by_the_bytes_of_their_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "it's")], "k long, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "")], "k long, t string")
    diff = verify.diff_rows(a, b)
    assert diff.columns == ["fingerprint", "source_count", "restore_count"]
    rows = a.unionByName(b)
    names = {r.fp: r.k for r in rows.select("k", row_fingerprint(rows).alias("fp")).collect()}
    got = sorted((names[r.fingerprint], r.source_count, r.restore_count) for r in diff.collect())
    assert got == [(1, 2, 1), (3, 1, 0), (4, 0, 1)]
    assert verify.diff_summary(a, b, "t").first().differing_rows == 3
    # no hex text travels: the text is made after the counts meet
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert "Aggregate [fp#" in grouped
    assert "unhex(sha2(" in plan
