"""Mixing sources to target weights, with DataFrame functions only.

- The words of each source are laid end to end and packed into blocks of a
  fixed number of words; a block may hold the end of one document and the
  start of the next.
- Every output shard has the same number of slots; each slot draws its source
  from the target weights, which gives every shard multinomial source counts.
  Draws beyond a source's quota of slots are drawn again among the sources
  that are still short, so the totals come out at the targets.
- Slot ``k`` of a source takes block ``perm(k mod n_blocks)`` of pass
  ``k div n_blocks``; ``perm`` is a swap-or-not permutation of the block
  indices (a keyed bijection of any range, computed, not stored), keyed by
  source and pass. Slots and blocks then meet in a join on the index.

Everything is a function of the rows and ``seed``: reruns and re-run tasks
agree. A hot source is never one task: its running sums are made in pieces
(``common.running_sum``), and draws, slots and blocks are spread by index.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)  # by source in code point order, repeating
SHARE = 1.5          # words of the mix, as a multiple of all words
MAX_PASSES = 2       # no source is taken more than this many times
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
ROUNDS = 12
SEED = 20
DOCS_PER_PIECE = 4096
PRIME = 2147483647   # modulus of the keyed bit function
#: Above this many sources the source table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 10_000


class Mixture(NamedTuple):
    sources: DataFrame  # sidx, source, source_size, target, n_blocks, quota
    rows: DataFrame     # sidx, doc_id, size, start: place of each document in its source's word stream
    slots: DataFrame    # shard, sidx, k, pass_no, block
    pieces: DataFrame   # sidx, start, block, words: the words of a document in a block


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """``(sidx, source, source_size, target)``: ``share`` of all words dealt by
    weight, no source above ``max_passes`` times its own words, the excess
    dealt again by weight. One row per source meets in one window."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sidx", (F.row_number().over(order) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sidx") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_passes)
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", "sidx")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    per = (per.withColumn("wanted", F.sum("cap").over(everything) / max_passes * share)
           .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("open_weight", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("open_weight"))
           .withColumn("place", F.row_number().over(full)))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(everything)
    per = per.withColumn("first", first)
    level = F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything)
    return (per.withColumn("final", level)
            .select("sidx", "source", "source_size",
                    F.when(F.col("place") < F.col("first"), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target")))


def source_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks per source and how many slots the source gets: whole passes over
    its blocks, and the rest of the target in blocks."""
    n = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    q = targets.withColumn("n_blocks", n)
    q = q.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                     .otherwise(F.lit(0)).cast("long"))
    rest = F.floor((F.col("target") - F.col("passes") * F.col("source_size")) / F.lit(float(block_words)) + 0.5)
    q = q.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.least(F.col("n_blocks"), rest.cast("long")))
    upto = Window.orderBy("sidx")
    return q.withColumn("hi", F.sum("quota").over(upto)).withColumn("lo", F.col("hi") - F.col("quota")).drop("passes")


def place_documents(sizes: DataFrame, n_rows: int) -> DataFrame:
    """``start``: the number of words of the source before each document. The
    order in a source is by a hash piece of the id, then id and size."""
    n_pieces = max(1, -(-n_rows // DOCS_PER_PIECE))
    piece = _hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n_pieces
    return common.running_sum(sizes.withColumn("piece", piece), ["sidx"], "piece",
                              [F.col("doc_id").asc_nulls_last(), F.col("size")], "size", "start")


def round_keys(source: str, n: str, passes: int, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """Per pass, the ``(key, shift)`` of each round of the permutation of
    ``[0, n)``; a row per source, made once."""
    def one(pass_no: Column, r: Column) -> Column:
        key = (F.col(source) * 7919 + pass_no * 104729 + r * 1299709 + F.lit(seed)) % PRIME * 48271 % PRIME
        return F.struct(key.alias("key"), ((key * PRIME + key * 16807 % PRIME) % F.greatest(F.lit(1), F.col(n))).alias("shift"))

    def upto(m: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))
    return F.transform(upto(passes), lambda p: F.transform(upto(rounds), lambda r: one(p, r)))


def permuted(index: str, n: str, keys: Column) -> Column:
    """Image of ``index`` under the swap-or-not permutation of ``[0, n)``
    (Hoang, Morris, Rogaway 2012): in each round a keyed bit of the unordered
    pair {x, shift - x} decides which of the two is taken, which makes every
    round a bijection."""
    size = F.col(n)

    def one_round(x: Column, k: Column) -> Column:
        other = (k["shift"] + size - x) % size
        bits = ((F.greatest(x, other) % PRIME * 48271 + k["key"]) % PRIME * 69621 + (x + other) % PRIME) % PRIME
        return F.when(F.shiftright(bits, 16) % 2 == 1, other).otherwise(x)
    return F.aggregate(keys, F.col(index), one_round)


def shard_counts(spark, quotas: DataFrame, n_slots: int, n_sources: int, small, seed: int = SEED) -> DataFrame:
    """``(shard, sidx, n)``: multinomial source counts per output shard. Slot
    ``i`` draws a number below the number of slots; the source whose quota
    interval holds it is found by an equi-join on grid bins of the intervals."""
    width = max(1, n_slots // (4096 + n_sources))
    drawn = (spark.range(n_slots).withColumn("u", _hash60(F.concat_ws(":", F.lit(seed), F.col("id"))) % n_slots)
             .select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), "u", F.expr(f"u div {width}").alias("bin")))
    grid = (quotas.filter("quota > 0")
            .select("sidx", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bin")))
    return (drawn.join(small(grid), "bin").filter("u >= lo and u < hi")
            .groupBy("shard", "sidx").agg(F.count("*").alias("n")))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES,
            block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mixture:
    """Plan the mix of all rows of ``docs(doc_id, source, text)``.

    A null text has no words. A null source is a source of its own, last in
    order. Null, repeated and tied ids keep their rows. An empty table gives an
    empty mix. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0))
                        .cast("long").alias("size"))
    sizes = common.stage(sizes, "mix-sizes")
    quotas = common.stage(source_quotas(source_targets(sizes, weights, share, max_passes), block_words), "mix-sources")
    n_rows = sizes.count()
    n_slots, n_sources = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)

    names = quotas.select("sidx", F.col("source").alias("_source"))
    rows = (sizes.join(small(names), F.col("source").eqNullSafe(F.col("_source")))
            .select("sidx", "doc_id", "size"))
    rows = common.stage(place_documents(rows, n_rows), "mix-rows").select("sidx", "doc_id", "size", "start")

    counts = common.stage(shard_counts(spark, quotas, n_slots, n_sources, small, seed), "mix-counts")
    totals = counts.groupBy("sidx").agg(F.sum("n").alias("_drawn"))
    upto = Window.orderBy("sidx")
    plan = (quotas.join(totals, "sidx", "left").withColumn("drawn", F.coalesce("_drawn", F.lit(0)))
            .withColumn("over", F.greatest(F.lit(0), F.col("drawn") - F.col("quota")))
            .withColumn("short", F.greatest(F.lit(0), F.col("quota") - F.col("drawn")))
            .withColumn("over_base", F.sum("over").over(upto) - F.col("over"))
            .withColumn("short_base", F.sum("short").over(upto) - F.col("short"))
            .select("sidx", "n_blocks", "quota", "drawn", "short", "over_base", "short_base"))
    plan = common.stage(plan, "mix-plan")
    placed = common.running_sum(counts.withColumn("major", F.expr("shard div 256")), ["sidx"], "major",
                                [F.col("shard")], "n", "offset")
    # a row here is a whole shard's share of a source: spread them before they are spelled out
    placed = placed.repartition(common.shuffle_partitions(spark), "shard", "sidx")
    drawn = (placed.select("shard", "sidx", F.explode(F.expr("sequence(offset, offset + n - 1)")).alias("k"))
             .join(small(plan.select("sidx", "quota", "over_base", "n_blocks")), "sidx"))
    kept = drawn.filter("k < quota").select("shard", "sidx", "k", "n_blocks")
    extra = drawn.filter("k >= quota").select("shard", (F.col("over_base") + F.col("k") - F.col("quota")).alias("m"))
    gaps = (plan.filter("short > 0")
            .select("sidx", "drawn", "short_base", "n_blocks", F.explode(F.expr("sequence(0L, short - 1)")).alias("j"))
            .select((F.col("short_base") + F.col("j")).alias("m"), "sidx", (F.col("drawn") + F.col("j")).alias("k"), "n_blocks"))
    again = extra.join(gaps, "m").select("shard", "sidx", "k", "n_blocks")
    keyed = quotas.select("sidx", round_keys("sidx", "n_blocks", max_passes, seed=seed).alias("keys"))
    slots = (kept.unionByName(again).withColumn("pass_no", F.expr("k div n_blocks"))
             .withColumn("i", F.expr("k % n_blocks")).join(small(keyed), "sidx"))
    slots = slots.select("shard", "sidx", "k", "pass_no",
                         permuted("i", "n_blocks", F.get("keys", F.col("pass_no").cast("int"))).alias("block"))

    b = block_words
    pieces = (rows.filter("size > 0")
              .select("sidx", "start", "size", F.explode(
                  F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
              .select("sidx", "start", "block", F.expr(
                  f"least((block + 1) * {b}, start + size) - greatest(block * {b}, start)").alias("words")))
    return Mixture(quotas, rows, slots, pieces)


def taken_words(mix: Mixture) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)``, one row per
    document: join the slots to the blocks by index and add up the words."""
    times = mix.slots.groupBy("sidx", "block").agg(F.count("*").alias("times"))
    used = (mix.pieces.join(times, ["sidx", "block"])
            .groupBy("sidx", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    # a document without words shares its start with the next one
    used = used.withColumn("some", F.lit(True))
    rows = mix.rows.withColumn("some", F.col("size") > 0)
    out = rows.join(used, ["sidx", "start", "some"], "left")
    n_sources = mix.sources.count()
    about = mix.sources.select("sidx", "source", "source_size", "target")
    about = F.broadcast(about) if n_sources <= BROADCAST_SOURCES else about
    return out.join(about, "sidx").select("doc_id", "size", "source", "source_size", "target",
                                          F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_sql(docs: str = "documents") -> str:
    """The same mix as DuckDB SQL over the table ``docs``."""
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    p, b = PRIME, BLOCK_WORDS
    steps = ["SELECT *, i AS x0 FROM numbered"]
    for r in range(ROUNDS):
        key = f"((((sidx * 7919 + pass_no * 104729 + {r * 1299709 + SEED}) % {p}) * 48271) % {p})"
        steps.append(
            f"SELECT * EXCLUDE (x{r}, key, other, mixed), CASE WHEN (mixed // 65536) % 2 = 1 THEN other ELSE x{r} END AS x{r + 1} FROM ("
            f"SELECT *, (((greatest(x{r}, other) % {p}) * 48271 + key) % {p} * 69621 + (x{r} + other) % {p}) % {p} AS mixed FROM ("
            f"SELECT *, ((key * {p} + (key * 16807) % {p}) % n_blocks + n_blocks - x{r}) % n_blocks AS other FROM ("
            f"SELECT *, {key} AS key FROM step{r})))")
    chain = ",\n".join(f"step{i} AS MATERIALIZED ({s})" for i, s in enumerate(steps))
    return f"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sidx FROM per),
weighed AS (SELECT *, CASE sidx % {len(WEIGHTS)} {weight} END::DOUBLE AS weight,
  source_size::DOUBLE * {MAX_PASSES} AS cap FROM ranked),
ratios AS (SELECT *, cap / weight AS ratio FROM weighed),
levels AS (SELECT *,
  ((sum(cap) OVER ()) / {MAX_PASSES} * {SHARE}
   - coalesce(sum(cap) OVER (ORDER BY ratio, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY ratio, sidx) AS place FROM ratios),
firsts AS (SELECT *, min(CASE WHEN ratio >= level THEN place END) OVER () AS first FROM levels),
finals AS (SELECT *, max(CASE WHEN place = first THEN level END) OVER () AS final FROM firsts),
targets AS (SELECT sidx, source, source_size,
  CASE WHEN place < first THEN cap ELSE least(cap, final * weight) END AS target FROM finals),
passes AS (SELECT *, ((source_size + {b - 1}) // {b})::BIGINT AS n_blocks,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets),
quota0 AS (SELECT *, (passes * n_blocks + least(n_blocks,
  floor((target - passes * source_size) / {float(b)} + 0.5)::BIGINT))::BIGINT AS quota FROM passes),
quotas AS MATERIALIZED (SELECT *, (sum(quota) OVER (ORDER BY sidx))::BIGINT AS hi,
  (sum(quota) OVER (ORDER BY sidx) - quota)::BIGINT AS lo FROM quota0),
n AS MATERIALIZED (SELECT coalesce(sum(quota), 0)::BIGINT AS slots, (SELECT count(*) FROM sizes) AS docs FROM quotas),
placed AS MATERIALIZED (SELECT q.sidx, s.doc_id, s.size,
  coalesce(sum(s.size) OVER (PARTITION BY q.sidx ORDER BY
    CAST('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 15) AS BIGINT)
      % greatest(1, (n.docs + {DOCS_PER_PIECE - 1}) // {DOCS_PER_PIECE}),
    s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source, n),
draws AS (SELECT i AS id, CAST('0x' || substr(md5('{SEED}:' || i), 1, 15) AS BIGINT) % (SELECT slots FROM n) AS u
  FROM n, range(n.slots) t(i)),
drawn AS MATERIALIZED (SELECT d.id, q.sidx,
  row_number() OVER (PARTITION BY q.sidx ORDER BY d.id // {SHARD_SLOTS}) - 1 AS k
  FROM draws d JOIN quotas q ON d.u >= q.lo AND d.u < q.hi),
plan0 AS (SELECT q.*, coalesce(t.drawn, 0) AS drawn FROM quotas q
  LEFT JOIN (SELECT sidx, count(*) AS drawn FROM drawn GROUP BY sidx) t USING (sidx)),
numbered AS MATERIALIZED (SELECT sidx, n_blocks, k, k // n_blocks AS pass_no, k % n_blocks AS i
  FROM plan0, range(quota) t(k)),
{chain},
times AS (SELECT sidx, x{ROUNDS} AS block, count(*) AS times FROM step{ROUNDS} GROUP BY ALL),
pieces AS (SELECT sidx, start, block, least((block + 1) * {b}, start + size) - greatest(block * {b}, start) AS words
  FROM (SELECT sidx, start, size, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block
        FROM placed WHERE size > 0)),
used AS (SELECT p.sidx, p.start, sum(p.words * t.times)::BIGINT AS taken
  FROM pieces p JOIN times t USING (sidx, block) GROUP BY ALL)
SELECT p.doc_id, p.size, q.source_size, q.target, coalesce(CASE WHEN p.size > 0 THEN u.taken END, 0)::BIGINT AS taken
FROM placed p JOIN quotas q USING (sidx) LEFT JOIN used u USING (sidx, start)"""
