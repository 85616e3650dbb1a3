"""Change sets of a table by key, and the table as of a time from a base and its
change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_fingerprint

OP, AT = "__op", "__at"
PUT, GONE = "put", "del"


def _match(keys: list[str], right: str):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{right}{k}"))
    return cond


def change_set(before: DataFrame, after: DataFrame, keys: list[str], at: int) -> DataFrame:
    """What leads from ``before`` to ``after``: the new or changed rows
    (``put``) and a tombstone with the key alone (``del``) for each row that
    went, with ``__op`` and ``__at``. Rows are compared by fingerprint, so only
    keys and fingerprints of ``before`` are moved. Both tables have the same
    columns and one row per key; a null is a key value like others."""
    fp = lambda df: row_fingerprint(df.select(*after.columns)).alias("__fp")
    old = before.select(*[F.col(k).alias(f"__b_{k}") for k in keys], fp(before).alias("__b_fp"))
    new = after.withColumn("__fp", fp(after))
    put = (new.join(old, _match(keys, "__b_"), "left").filter(~F.col("__fp").eqNullSafe(F.col("__b_fp")))
           .select(*after.columns, F.lit(PUT).alias(OP)))
    gone = old.join(after.select(*keys), _match(keys, "__b_"), "left_anti")
    tombs = gone.select(*[(F.col(f"__b_{f.name}") if f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in after.schema.fields],
                        F.lit(GONE).alias(OP))
    return put.unionByName(tombs).withColumn(AT, F.lit(at).cast("long"))


def state_at(base: DataFrame, changes: DataFrame, keys: list[str], at: int) -> DataFrame:
    """The table at time ``at``: for every key the newest version among the
    base and the changes up to then, without keys whose newest is a tombstone.
    One aggregate with map-side combine, whatever the number of change sets;
    a change set applied twice changes nothing."""
    first = base.withColumn(OP, F.lit(PUT)).withColumn(AT, F.lit(-(1 << 63)).cast("long"))
    versions = first.unionByName(changes.filter(F.col(AT) <= at).select(*first.columns))
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*base.columns, OP), F.col(AT)).alias("v"))
    return newest.filter(F.col(f"v.{OP}") == PUT).select("v.*").select(*base.columns)
