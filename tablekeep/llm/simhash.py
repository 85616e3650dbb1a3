"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of four bits; its embedding is
the vector of the 16 bit counts. One flipped bit moves one count by one, so
the Manhattan distance of two embeddings is a lower bound of the Hamming
distance of the fingerprints. The join finds pairs within two bits:

1. **Grid range-join.** Two lattice points are within Manhattan distance 2 if
   and only if their balls of radius 1 share a lattice point. Each distinct
   fingerprint is sent to the (at most 33) cells of its ball; a cell holding
   fewer than two fingerprints is dropped.
2. **Exact check.** In the cells that remain, a fingerprint is sent to those
   fingerprints that lie in the cell and differ from it in at most one bit
   (itself, or one bit of the moved segment). Two fingerprints differ in at
   most two bits exactly if they meet at such a midpoint, and all that meet at
   one midpoint (65 at most) are within two bits of each other, so linking
   them to the smallest gives the same components as all pairs.

No step makes pairs within a group: a fingerprint yields at most 33 cells and
65 midpoints however many neighbours it has. Copies collapse to one
fingerprint first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENTS, SEGMENT_BITS = 16, 4


def shingle_fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit number.
    Words are lower-cased (A-Z only); a text with fewer words than a shingle
    is one shingle; a text without words has fingerprint 0. A bit is set if it
    is set in over half of the shingles' XXH64 values, repeats included."""
    words = common.utf8(text).lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, seed) for g in grams]), dtype=np.uint8)
    n = len(hashes) // 8
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 19):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i:i + (1 << 19)]).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint
    as a signed long."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([shingle_fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_arrow(narrow, run, "doc_id long, fp long")


def _spread_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts per 4-bit segment, packed as 16 nibbles of a 64-bit number."""
    one, three = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)
    pairs = fp - ((fp >> np.uint64(1)) & one)
    return (pairs & three) + ((pairs >> np.uint64(2)) & three)


def _cells(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(cell, fp, move): the grid cells within Manhattan distance 1 of each
    embedding. ``move`` is -1 for the own cell, else 2 * segment + (1 if the
    count grows)."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    own = _spread_counts(fp)
    cells, fps, moves = [own], [fp], [np.full(len(fp), -1, np.int8)]
    for seg in range(SEGMENTS):
        unit = np.uint64(1) << np.uint64(SEGMENT_BITS * seg)
        count = (own >> np.uint64(SEGMENT_BITS * seg)) & np.uint64(15)
        for up in (0, 1):
            ok = count < SEGMENT_BITS if up else count > 0
            cells.append(own[ok] + unit if up else own[ok] - unit)
            fps.append(fp[ok])
            moves.append(np.full(int(ok.sum()), 2 * seg + up, np.int8))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)),
         pa.array(np.concatenate(moves))], names=["cell", "fp", "move"])


def _midpoints(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(mid, fp): the fingerprints at most one bit away that lie in the cell
    to which ``move`` leads."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    move = batch.column(1).to_numpy()
    mids, fps = [fp[move == -1]], [fp[move == -1]]
    seg, up = np.maximum(move, 0) // 2, np.maximum(move, 0) % 2
    for bit in range(SEGMENT_BITS):
        mask = np.uint64(1) << (seg * SEGMENT_BITS + bit).astype(np.uint64)
        ok = (move >= 0) & (((fp & mask) == 0) == (up == 1))
        mids.append(fp[ok] ^ mask[ok])
        fps.append(fp[ok])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(mids).view(np.int64)),
                                       pa.array(np.concatenate(fps).view(np.int64))], names=["mid", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the fingerprints of ``distinct(fp)`` such that
    their components are those of all pairs within two bits."""
    cells = common.map_arrow(distinct, _cells, "cell long, fp long, move byte")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    near = cells.join(shared, "cell", "left_semi")
    mids = common.map_arrow(near.select("fp", "move"), _midpoints, "mid long, fp long")
    # at most 65 fingerprints lie within one bit of a midpoint
    met = mids.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a <> b").select("a", "b")


def classes(fps: DataFrame) -> DataFrame:
    """``(fp, root)``: the component of every fingerprint of ``fps(fp, ...)``."""
    distinct = common.stage(fps.select("fp").distinct(), "distinct-fingerprints")
    roots = common.components(links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``, the
    smallest id reachable over links of at most two differing bits.

    Null or empty texts have fingerprint 0 and link like any other. Null ids
    keep their row and never become a component id (a component of null ids
    only has a null one). Repeated rows give repeated rows. Columns other than
    the id and the text are ignored, whatever their names.
    """
    fps = common.stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    lows = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = lows.join(classes(fps), "fp")
    component = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    class_of = rooted.join(component, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(class_of, fps.fp == class_of._fp).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row left of each component: the one with the smallest
    ``doc_id`` (null ids last, then by text hash); all columns stay. Of rows
    equal in id and text one stays."""
    text_hash = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([shingle_fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                          names=["doc_id", "text_hash", "fp"])
    fps = common.stage(common.map_arrow(keyed, run, "doc_id long, text_hash long, fp long"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    lows = fps.groupBy("fp").agg(F.min(row).alias("low"))
    kept = (lows.join(classes(fps), "fp").groupBy("root").agg(F.min("low").alias("low"))
            .select(F.col("low.doc_id").alias("_rep_d"), F.col("low.text_hash").alias("_rep_h")))
    out = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_rep_d")) & (text_hash == F.col("_rep_h")), "left_semi")
    if fps.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        out = (out.withColumn("_rep_h", text_hash).dropDuplicates(["doc_id", "_rep_h"])).drop("_rep_h")
    return out
