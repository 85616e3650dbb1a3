"""LM scoring by cross-entropy difference.

Two word bigram models over one shared vocabulary (all words of the corpus
and an end mark), of the same order and smoothing: the target model counts
the trusted (target) documents, the background model all documents. A
document's score is the mean over its tokens of target loss minus background
loss, in nats: the lower, the closer to the target.

    P1(w)   = (1 - LAM) c_t(w) / N_t + LAM c_b(w) / N_b      (target)
    P1(w)   = c_b(w) / N_b                                   (background)
    P(w|v)  = (c(v, w) + MU P1(w)) / (c(v) + MU)             (both)

A target document's own counts are taken out of the target model before it is
scored, so that it does not vouch for itself.

Counting covers every token of every document. Documents are grouped by a
hash of the id; a group sends each different n-gram once, with its counts, to
the n-gram's bucket, where the counts of all groups are added; the sums go
back to the groups that asked, in the order they asked, so no keys return.
A frequent word is one row a group. The texts pass one shuffle, shared by
counting and scoring. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.session import ship_package

from . import common

LAM, MU = 0.2, 5.0
GROUP_BYTES = 16 << 20
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
TOTALS = -1  # bucket of the corpus totals


def word_keys(text: bytes) -> np.ndarray:
    """64-bit hashes of the words and the end mark."""
    digest = xxhash.xxh64_digest
    words = np.frombuffer(b"".join([digest(w) for w in text.split()]), "<u8")
    return np.append(words, END)


def pair_keys(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of (word before, word); the first word follows a start mark."""
    before = np.concatenate([[START], words[:-1]])
    x = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


class _Group:
    """The documents of a group, their n-grams and which are targets."""

    def __init__(self, left: pa.Table, right: pa.Table):
        marks = right.filter(pc.equal(right.column("kind"), 0))
        targets = set(marks.column("doc_id").to_pylist())
        rows = sorted(zip(left.column("doc_id").to_pylist(), left.column("data").to_pylist()),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [i for i, _ in rows]
        self.target = np.array([i is not None and i in targets for i in self.ids], dtype=bool)
        words = [word_keys(t) for _, t in rows]
        self.sizes = np.array([len(w) for w in words], np.int64)
        # words, pairs and the start mark are one key space
        both = np.concatenate([*words, *[pair_keys(w) for w in words], [START]])
        keys, at = np.unique(both, return_inverse=True)
        n = int(self.sizes.sum())
        self.keys, self.word, self.pair, self.start = keys, at[:n], at[n:2 * n], int(at[2 * n])
        self.of_target = np.repeat(self.target, self.sizes)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs, in all and in target documents; the
        start mark stands once before every document."""
        out = []
        for rows in (slice(None), self.of_target):
            c = np.bincount(self.word[rows], minlength=len(self.keys)) + np.bincount(self.pair[rows], minlength=len(self.keys))
            c[self.start] += len(self.ids) if isinstance(rows, slice) else int(self.target.sum())
            out.append(c.astype(np.int64))
        return out[0], out[1]

    def buckets(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the keys by bucket, the buckets met, and the cuts."""
        bucket = (self.keys >> np.uint64(33)) % np.uint64(n_buckets)
        order = np.lexsort((self.keys, bucket))
        sorted_ = bucket[order].astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1])
        return order, sorted_[starts], np.append(starts, len(order))


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # bytes of equal weight together


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _count(n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"hb": [], "db": [], "keys": [], "all": [], "target": []}
        if left.num_rows:
            group = _Group(left, right)
            c_all, c_target = group.counts()
            order, buckets, cuts = group.buckets(n_buckets)
            db = left.column("db")[0].as_py()
            for b, s, e in zip(buckets, cuts[:-1], cuts[1:]):
                at = order[s:e]
                for c, v in zip(rows, (int(b), db, group.keys[at].astype("<u8").tobytes(), _pack(c_all[at]), _pack(c_target[at]))):
                    rows[c].append(v)
            tokens = np.array([len(group.of_target)]), np.array([int(group.of_target.sum())])
            for c, v in zip(rows, (TOTALS, db, np.zeros(1, "<u8").tobytes(), _pack(tokens[0]), _pack(tokens[1]))):
                rows[c].append(v)
        return pa.table([pa.array(rows["hb"], pa.int32()), pa.array(rows["db"], pa.int32()),
                         *[pa.array(rows[c], pa.binary()) for c in ("keys", "all", "target")]], names=list(rows))
    return run


def _add(table: pa.Table) -> pa.Table:
    """Sums of a bucket's counts over all groups, for each group that asked."""
    keys = [np.frombuffer(b, "<u8") for b in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = {"hb": table.column("hb").combine_chunks(), "db": table.column("db").combine_chunks()}
    for c in ("all", "target"):
        mine = np.concatenate([_unpack(b) for b in table.column(c).to_pylist()])
        total = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(total, at, mine)
        parts = np.split(total[at], np.cumsum(sizes)[:-1])
        out[c] = pa.array([_pack(p) for p in parts], pa.binary())
    return pa.table(out)


def _score(n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"doc_id": [], "n_tokens": [], "target_loss": [], "background_loss": []}
        if left.num_rows:
            group = _Group(left, right)
            got = right.filter(pc.equal(right.column("kind"), 1))
            replies = dict(zip(got.column("hb").to_pylist(), zip(got.column("all").to_pylist(), got.column("target").to_pylist())))
            order, buckets, cuts = group.buckets(n_buckets)
            c_all, c_target = np.zeros(len(group.keys)), np.zeros(len(group.keys))
            for b, s, e in zip(buckets, cuts[:-1], cuts[1:]):
                c_all[order[s:e]], c_target[order[s:e]] = map(_unpack, replies[int(b)])
            n_all, n_target = (float(_unpack(x)[0]) for x in replies[TOTALS])
            stops = np.cumsum(group.sizes)
            for i, (s, e) in enumerate(zip(stops - group.sizes, stops)):
                word, pair = group.word[s:e], group.pair[s:e]
                before = np.concatenate([[group.start], word[:-1]])
                t_word, t_pair, t_before, n_t = c_target[word], c_target[pair], c_target[before], n_target
                if group.target[i]:  # without the document's own counts
                    own = np.bincount(np.unique(word, return_inverse=True)[1])[np.unique(word, return_inverse=True)[1]]
                    own_pair = np.bincount(np.unique(pair, return_inverse=True)[1])[np.unique(pair, return_inverse=True)[1]]
                    t_word, t_pair, n_t = t_word - own, t_pair - own_pair, n_t - len(word)
                    t_before = t_before - np.concatenate([[1], own[:-1]])
                p_back = c_all[word] / n_all
                p_target = (1 - LAM) * t_word / n_t + LAM * p_back if n_t > 0 else p_back
                cols["doc_id"].append(group.ids[i])
                cols["n_tokens"].append(int(e - s))
                cols["target_loss"].append(float(-np.log((t_pair + MU * p_target) / (t_before + MU)).mean()))
                cols["background_loss"].append(float(-np.log((c_all[pair] + MU * p_back) / (c_all[before] + MU)).mean()))
        return pa.table([pa.array(cols["doc_id"], pa.int64()), pa.array(cols["n_tokens"], pa.int64()),
                         pa.array(cols["target_loss"], pa.float64()), pa.array(cols["background_loss"], pa.float64())], names=list(cols))
    return run


def score_documents(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)``, one row per
    row of ``docs``; ``targets(doc_id)`` names the target documents.

    Every document has an end mark as a token, so a null or empty text has one
    token. A null id is no target. Repeated rows count as often as they occur
    and each gets a row. Without targets the target model is the background's
    word shares. An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    n_groups = n_buckets = max(common.shuffle_partitions(spark), -(-total // GROUP_BYTES))

    def group_of(df: DataFrame, key) -> DataFrame:
        return df.withColumn("db", F.pmod(key, F.lit(n_groups)).cast("int"))
    # the rows of an id with more than a group's bytes are spread by their texts over as many groups as they fill; there
    # are fewer such ids than groups. Null ids are spread by their texts too.
    heavy = (rows.filter("doc_id is not null").groupBy("doc_id").agg(F.sum(F.octet_length("data")).alias("bytes"))
             .filter(F.col("bytes") > GROUP_BYTES).select(F.col("doc_id").alias("heavy_id"), F.ceil(F.col("bytes") / GROUP_BYTES).alias("parts")).collect())
    heavy = F.broadcast(spark.createDataFrame(heavy, "heavy_id long, parts long"))
    spread = rows.join(heavy, F.col("doc_id") == F.col("heavy_id"), "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("data"), F.col("parts")))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("data")).otherwise(F.xxhash64("doc_id", part.cast("long")))
    texts = group_of(spread, key).select("doc_id", "data", "db").groupBy("db")
    marks = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    marks = marks.join(heavy, F.col("doc_id") == F.col("heavy_id"), "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
    marks = group_of(marks, F.xxhash64("doc_id", "part")).select("doc_id", "db").withColumn("kind", F.lit(0))
    counted = texts.cogroup(marks.groupBy("db")).applyInArrow(
        _count(n_buckets), "hb int, db int, keys binary, all binary, target binary")
    sums = (counted.groupBy("hb").applyInArrow(_add, "hb int, db int, all binary, target binary")
            .withColumns({"kind": F.lit(1), "doc_id": F.lit(None).cast("long")}))
    nothing = F.lit(None).cast("binary")
    told = marks.withColumns({"hb": F.lit(None).cast("int"), "all": nothing, "target": nothing}).unionByName(sums)
    scored = texts.cogroup(told.groupBy("db")).applyInArrow(
        _score(n_buckets), "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
