"""Benchmark decontamination by template canonicalisation, with DataFrame
functions only.

- **Canonical tokens.** Punctuation and white space separate tokens, letters
  are lower-cased. Numbers (with signs, decimal and group marks), units that
  follow a number, and names (a capitalised word inside a sentence) become
  typed placeholders; the value stays beside the placeholder.
- **Template windows.** Every window of ``WINDOW`` canonical tokens of every
  whole text is hashed and joined to the windows of the benchmark items. A
  window counts if at least ``MIN_LITERALS`` of its tokens are words, not
  placeholders. Items are indexed with names as placeholders and as plain
  words, so a text in lower case is found too.
- **Weak windows.** Windows with fewer words (``WEAK_LITERALS`` at least), as
  arithmetic items have, count where the windows of one alignment hold
  ``MIN_LITERALS`` different words of the item between them.
- **Exact windows.** Item windows with fewer words, and whole items of
  ``MIN_LITERALS`` to ``WINDOW`` - 1 tokens, are joined by their tokens with
  all values, so verbatim copies of them are found.
- **Slot consistency.** Windows of one document and item at the same offset
  are one alignment. In it, equal slot values of the item must stand against
  equal values in the document; windows that cover a value that breaks this are
  dropped. The rest is a leak: verbatim if all values are equal, else
  re-parameterised.
- A document and an item are reported if ``MIN_WINDOWS`` different windows of
  the item match (all of them, for items with fewer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_LITERALS = 5
MIN_WINDOWS = 6
WEAK_LITERALS = 2
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"  # private-use characters: marks of the slot types
#: Fixed list of unit words, recognised after a number.
UNITS = ("%|percent|km|kilometers?|kilometres?|m|meters?|metres?|cm|mm|miles?|mi|ft|feet|foot|inch(?:es)?|yards?|kg|kilograms?|g|grams?|mg"
         "|tons?|tonnes?|lbs?|pounds?|oz|ounces?|l|liters?|litres?|ml|gallons?|seconds?|secs?|s|minutes?|mins?|hours?|hrs?|h|days?|weeks?"
         "|months?|years?|dollars?|euros?|cents?|usd|eur|mph|kmh|degrees?|volts?|v|watts?|w|kw|joules?|j|hz|ghz|mb|gb|tb|kb")
#: The benchmark's windows are broadcast up to this many rows, and the matched
#: documents up to this many; beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_MATCHES = 100_000


def canonical_text(text: Column) -> Column:
    """Lower-case tokens with one blank between them: numbers as they are
    (without group and decimal marks), names and units with a mark before
    them. Each pattern begins with a plain character, so that most positions
    of a text are passed over at once."""
    plain = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "")
    plain = F.regexp_replace(plain, r"([0-9])[.,](?=[0-9])", "$1")
    plain = F.regexp_replace(plain, rf"([0-9])\x20?(?i:({UNITS}))(?![\p{{L}}\p{{Nd}}])", f"$1 {UNIT}$2")
    plain = F.replace(plain, F.lit(f"{UNIT}%"), F.lit(f"{UNIT}percent"))
    plain = F.regexp_replace(plain, r"\x20(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{Nd},;]\x20)", f" {NAME}")
    plain = F.regexp_replace(plain, rf"[^a-zA-Z0-9\p{{L}}\p{{M}}\p{{Nd}}{NAME}{UNIT}]+", " ")
    return F.trim(F.lower(plain))


def template_text(canonical: Column) -> Column:
    """Placeholders in place of numbers, names and units."""
    marked = F.regexp_replace(canonical, rf"([{NAME}{UNIT}])[^\x20]+", "$1")
    return F.regexp_replace(marked, r"[0-9](?<![^\x20].)[^\x20]*", NUMBER)


def canonical_tokens(text: Column) -> Column:
    return F.split(canonical_text(text), " ")


def template_tokens(text: Column) -> Column:
    return F.split(template_text(canonical_text(text)), " ")


def _hashes(tokens: str, window: int) -> Column:
    at = F.sequence(F.lit(1), F.size(tokens) - (window - 1))
    return F.when(F.size(tokens) >= window, F.transform(at, lambda i: F.xxhash64(F.slice(F.col(tokens), i, F.lit(window)))))


def item_windows(items: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """``(hash, item_id, ipos, slots, weak)`` of the windows of the items, with
    names as placeholders and as words. Windows with fewer than
    ``min_literals`` words are weak; with fewer than ``WEAK_LITERALS`` they
    are left out."""
    texts = items.select("item_id", canonical_text(F.col("text")).alias("text"))
    texts = texts.unionByName(texts.select("item_id", F.translate("text", NAME, "").alias("text")))
    forms = texts.select("item_id", F.split(template_text(F.col("text")), " ").alias("form"))
    at = F.when(F.size("form") >= window, F.sequence(F.lit(1), F.size("form") - (window - 1)))
    rows = forms.select("item_id", "form", F.explode(at).alias("at"))
    rows = rows.withColumn("part", F.slice("form", F.col("at"), F.lit(window)))
    slots = F.size(F.filter("part", lambda t: t.isin(NUMBER, NAME, UNIT)))
    return (rows.select(F.xxhash64("part").alias("hash"), "item_id", (F.col("at") - 1).alias("ipos"), slots.alias("slots"))
            .filter(F.col("slots") <= window - WEAK_LITERALS).withColumn("weak", F.col("slots") > window - min_literals).distinct())


def exact_tokens(canonical: Column) -> Column:
    return F.split(F.translate(canonical, NAME + UNIT, ""), " ")


def exact_windows(items: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """``(hash, item_id, ipos, n)`` of the windows that ``item_windows`` leaves
    out for their slots, and of whole items of ``min_literals`` tokens up to a
    window, by their ``n`` tokens with values."""
    texts = items.select("item_id", canonical_text(F.col("text")).alias("text"))
    forms = texts.select("item_id", F.split(template_text(F.col("text")), " ").alias("form"), exact_tokens(F.col("text")).alias("tokens"))
    n = F.least(F.size("form"), F.lit(window))
    rows = forms.filter(F.size("form") >= min(window, min_literals)).select(
        "item_id", "form", "tokens", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("form") - n + 1)).alias("at"))
    slots = F.size(F.filter(F.slice("form", F.col("at"), F.col("n")), lambda t: t.isin(NUMBER, NAME, UNIT)))
    # inside a document the first word of an item may be taken for a name
    few = slots + (F.col("at") == 1).cast("int") > window - min_literals
    return (rows.filter(few | (F.col("n") < window))
            .select(F.xxhash64(F.slice("tokens", F.col("at"), F.col("n"))).alias("hash"), "item_id",
                    (F.col("at") - 1).alias("ipos"), "n").distinct())


def _exact_hits(docs: DataFrame, index: DataFrame, window: int, min_literals: int, small) -> DataFrame:
    """``(doc_id, text_hash, item_id, ipos)`` of exact windows in the
    documents; one scan for windows of all lengths."""
    lengths = sorted(r.n for r in index.select("n").distinct().collect())  # at most as many as a window has tokens
    texts = _keyed(docs).select("doc_id", "text_hash", canonical_text(F.col("text")).alias("text"))
    form = template_text(F.col("text"))
    slots = F.length(form) - F.length(F.translate(form, NUMBER + NAME + UNIT, ""))
    tokens = texts.select("doc_id", "text_hash", exact_tokens(F.col("text")).alias("tokens"),
                          # texts with fewer slots hold none of the windows of full length
                          (slots > window - min_literals if window in lengths else F.lit(False)).alias("many"))

    def of_length(n: int) -> Column:
        named = F.transform(_hashes("tokens", n), lambda h: F.struct(F.lit(n).alias("n"), h.alias("hash")))
        return F.coalesce(F.when(F.col("many") if n == window else F.lit(True), named), F.array().cast("array<struct<n:int,hash:bigint>>"))
    hashes = [of_length(n) for n in lengths]
    windows = tokens.select("doc_id", "text_hash", F.explode_outer(F.concat(*hashes)).alias("w")).select("doc_id", "text_hash", "w.n", "w.hash")
    return windows.join(small(index), ["n", "hash"]).select("doc_id", "text_hash", "item_id", "ipos").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    # rows are told apart by id and text: equal rows are one document
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS,
          min_windows: int = MIN_WINDOWS) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_windows, item_windows, kind)``: one row
    per contaminated document and item. ``kind`` is ``verbatim`` or
    ``reparameterised``.

    Null texts and items are empty and match nothing, as do items of fewer than
    ``min_literals`` tokens. ``n_windows`` and ``item_windows`` count template
    and exact windows; enough of the template windows alone, or of those that
    are not weak, also report a document. A null ``doc_id`` is reported as null. Rows equal in id and text
    are one document; items that share an id count as one item. Empty tables
    give an empty result; other columns are ignored, whatever their names.
    """
    index = common.stage(item_windows(items, window, min_literals), "item-windows")
    small = F.broadcast if index.count() <= BROADCAST_ROWS else (lambda df: df)
    exact = common.stage(exact_windows(items, window, min_literals), "item-exact-windows")
    places = index.select("item_id", "ipos", F.lit(True).alias("template"), (~F.col("weak")).alias("open"))
    places = places.unionByName(exact.select("item_id", "ipos", F.lit(False).alias("template"), F.lit(False).alias("open")))
    totals = (places.groupBy("item_id", "ipos").agg(F.max("template").alias("template"), F.max("open").alias("open")).groupBy("item_id")
              .agg(F.count("*").alias("item_windows"), F.count_if("template").alias("item_template"), F.count_if("open").alias("item_open")))

    forms = _keyed(docs).select("doc_id", "text_hash", template_tokens(F.col("text")).alias("form"))
    hashed = forms.select("doc_id", "text_hash", _hashes("form", window).alias("hashes"))
    # the outer form keeps the optimiser from computing the hashes twice, once to filter empty arrays
    windows = hashed.select("doc_id", "text_hash", F.posexplode_outer("hashes").alias("pos", "hash"))
    hits = (windows.join(small(index), "hash")
            .groupBy("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
            .agg(F.collect_set(F.struct("ipos", "weak")).alias("at"), F.max("slots").alias("slots")))
    hits = common.stage(hits, "template-hits")

    plain = hits.filter("slots = 0").select("doc_id", "text_hash", "item_id", "at", F.lit(True).alias("same"))
    open_hits = hits.filter("slots > 0")
    n_open = open_hits.count()
    if n_open:
        aligned = _consistent(docs, items, open_hits, n_open, window)
        plain = plain.unionByName(aligned)
    places = (plain.select("doc_id", "text_hash", "item_id", "same", F.explode("at").alias("at"))
              .select("doc_id", "text_hash", "item_id", "same", F.col("at.ipos").alias("ipos"), F.lit(True).alias("template"),
                      (~F.col("at.weak")).alias("open")))
    n_exact = exact.count()
    if n_exact:
        put = F.broadcast if n_exact <= BROADCAST_ROWS else (lambda df: df)
        literal = _exact_hits(docs, exact, window, min_literals, put)
        places = places.unionByName(literal.select("doc_id", "text_hash", "item_id", F.lit(True).alias("same"), "ipos",
                                                      F.lit(False).alias("template"), F.lit(False).alias("open")))
    found = (places.groupBy("doc_id", "text_hash", "item_id", "ipos")
             .agg(F.min("same").alias("same"), F.max("template").alias("template"), F.max("open").alias("open"))
             .groupBy("doc_id", "text_hash", "item_id")
             .agg(F.count("*").alias("n_windows"), F.count_if("template").alias("n_template"), F.count_if("open").alias("n_open"),
                  F.min("same").alias("same")))
    enough = F.col("n_windows") >= F.least(F.lit(min_windows), F.col("item_windows"))
    for kind in ("template", "open"):
        enough = enough | ((F.col(f"item_{kind}") > 0) & (F.col(f"n_{kind}") >= F.least(F.lit(min_windows), F.col(f"item_{kind}"))))
    return (found.join(totals, "item_id").filter(enough)
            .select("doc_id", "text_hash", "item_id", "n_windows", "item_windows",
                    F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind")))


def _consistent(docs: DataFrame, items: DataFrame, hits: DataFrame, n_hits: int, window: int) -> DataFrame:
    """The windows of alignments whose slots are consistent: equal values of
    the item stand against equal values of the document. A window that covers
    a value that stands against several is left out, and so are the weak
    windows of an alignment that cover fewer than ``MIN_LITERALS`` different
    words of the item between them."""
    item_tokens = items.select(F.col("item_id").alias("_item"), canonical_tokens(F.col("text")).alias("item_tokens"),
                               template_tokens(F.col("text")).alias("item_form"))
    wanted = hits.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    wanted = F.broadcast(wanted) if n_hits <= BROADCAST_MATCHES else wanted
    rows = (_keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
            .dropDuplicates(["doc_id", "text_hash", "item_id", "shift"])
            .join(item_tokens, F.col("item_id").eqNullSafe(F.col("_item")))
            .select("doc_id", "text_hash", "item_id", "at", "shift", "item_tokens", "item_form", canonical_tokens(F.col("text")).alias("tokens")))

    def bare(t: Column) -> Column:
        return F.when(F.substring(t, 1, 1).isin(NAME, UNIT), F.substring(t, 2, 1 << 30)).otherwise(t)

    def covered(at: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p["ipos"], p["ipos"] + window - 1))))
    is_slot = lambda p: F.get("item_form", p).isin(NUMBER, NAME, UNIT)
    slots = F.transform(F.filter(covered(F.col("at")), is_slot), lambda p: F.struct(
        bare(F.get("item_tokens", p)).alias("of_item"), bare(F.get("tokens", p + F.col("shift").cast("int"))).alias("of_doc"), p.alias("pos")))
    rows = rows.withColumn("slots", slots)
    rows = rows.withColumn("pairs", F.array_distinct(F.transform("slots", lambda x: F.struct(x["of_item"].alias("of_item"), x["of_doc"].alias("of_doc")))))
    broken = F.filter("slots", lambda x: F.size(F.filter("pairs", lambda y: y["of_item"] == x["of_item"])) > 1)
    rows = rows.withColumn("broken", F.transform(broken, lambda x: x["pos"]))
    rows = rows.withColumn("at", F.filter("at", lambda p: ~F.exists("broken", lambda q: q.between(p["ipos"], p["ipos"] + window - 1))))
    words = F.array_distinct(F.transform(F.filter(covered(F.col("at")), lambda p: ~is_slot(p)), lambda p: F.get("item_tokens", p)))
    rows = rows.withColumn("words", F.size(words))
    rows = rows.withColumn("at", F.filter("at", lambda p: ~p["weak"] | (F.col("words") >= MIN_LITERALS))).filter("size(at) > 0")
    kept = covered(F.col("at"))
    same = F.forall(F.filter("slots", lambda x: F.array_contains(kept, x["pos"])), lambda x: x["of_item"] == x["of_doc"])
    return rows.select("doc_id", "text_hash", "item_id", "at", same.alias("same"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a leak; all columns stay."""
    found = common.stage(leaks(docs, items).select(F.col("doc_id").alias("_leak_d"), F.col("text_hash").alias("_leak_h")).distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= BROADCAST_MATCHES else found
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_leak_d"))
                     & (F.xxhash64("text") == F.col("_leak_h")), "left_anti")
