"""Restore from SQL text that another tool wrote: one file, or pieces in path
order, with strings that may hold line feeds, quotes, semicolons and brackets.

Where a statement or a tuple ends depends on all text before it (is this quote
the start of a string or its end?), yet the text is read in parallel:

1. The text is cut into chunks of whole lines and staged. For each state the
   lexer may be in at the start of a chunk (plain text, one of three kinds of
   quotes, a comment) a task finds the state at its end, the change of the
   bracket depth and where VALUES occurs: the chunk's map.
2. The maps, a few numbers per chunk, are composed in the order of the text, so
   every chunk's true entry state is known.
3. Every chunk is read once more from its true state: tuples that are whole are
   rows, the ends of a tuple that crosses chunks are joined by one grouping,
   and the head of the statement open at the end of a chunk (its table and
   column list, not its tuples) is handed to the chunks after it.
4. The types come from the text's own CREATE TABLE statements; tuples are cut
   into literals and cast by JVM expressions.

The driver holds one map and one statement head per chunk of up to
``CHUNK_BYTES`` of text, never rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ddl
from ..functions.literals import from_utc_text
from ..session import scratch_path, ship_package

CHUNK_BYTES = 1 << 20
#: Staged chunks: a row group is checked against its size after every row, since
#: a chunk is as large as a hundred thousand usual rows.
_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
LINES = 1_000  # lines of a batch that are Python texts at once
#: Tables with one row per chunk are broadcast up to this many rows.
BROADCAST_CHUNKS = 100_000

PLAIN, QUOTE, DOUBLE, BACKTICK, COMMENT = range(5)
_OPENS = {"'": QUOTE, '"': DOUBLE, "`": BACKTICK, "/": COMMENT}
_QUOTED = r"'(?:[^'\\]++|\\.|'')*+(')?|" r'"(?:[^"\\]++|\\.|"")*+(")?|' r"`(?:[^`]++|``)*+(`)?|/\*(?:[^*]++|\*(?!/))*+(\*/)?"
_EVENT = re.compile(_QUOTED + r"|(?:--(?=\s|\Z)|\#)[^\n]*+|([();])|\b((?i:values?))\b", re.S)
_REST = {QUOTE: re.compile(r"(?:[^'\\]++|\\.|'')*+(')?", re.S), DOUBLE: re.compile(r'(?:[^"\\]++|\\.|"")*+(")?', re.S),
         BACKTICK: re.compile(r"(?:[^`]++|``)*+(`)?", re.S), COMMENT: re.compile(r"(?:[^*]++|\*(?!/))*+(\*/)?", re.S)}


def events(text: str, mode: int) -> tuple[list[tuple[str, int, int]], int]:
    """Brackets, semicolons and VALUES words ("V") outside quotes and comments,
    with start and end, and the state after the text. A chunk ends with a line
    feed, so nothing but a quoted text or a comment goes on in the next."""
    at = 0
    if mode != PLAIN:
        m = _REST[mode].match(text)
        if not m[1]:
            return [], mode
        at = m.end()
    found = []
    for m in _EVENT.finditer(text, at):
        if m.lastindex is None:
            if m[0][0] in _OPENS:
                return found, _OPENS[m[0][0]]
        elif m.lastindex > 4:
            found.append((m[0] if m.lastindex == 5 else "V", m.start(), m.end()))
    return found, PLAIN


@dataclass(frozen=True)
class Entry:
    """The state at the start of a chunk."""

    mode: int = PLAIN
    depth: int = 0
    in_values: bool = False


def chunk_map(text: str) -> list[tuple[int, bool, int, bool, list[int]]]:
    """For each entry mode: mode after, whether a statement ends, depth after
    (from 0 at the last statement's end, or relative to the entry's), whether
    VALUES follows the last end, and the relative depths of VALUES before any
    end."""
    out = []
    for mode in range(5):
        found, after = events(text, mode)
        depth, ended, values, relative = 0, False, False, set()
        for kind, _, _ in found:
            if kind == ";":
                depth, ended, values = 0, True, False
            elif kind == "V":
                values = values or (ended and depth == 0)
                if not ended:
                    relative.add(depth)
            else:
                depth += 1 if kind == "(" else -1
        out.append((after, ended, depth, values, sorted(relative)))
    return out


def compose(entry: Entry, maps: list[tuple]) -> Entry:
    """The state after a chunk that is entered in ``entry``."""
    after, ended, depth, values, relative = maps[entry.mode]
    if ended:
        return Entry(after, depth, values)
    return Entry(after, entry.depth + depth, entry.in_values or any(entry.depth + r == 0 for r in relative))


@dataclass
class Pieces:
    """What a chunk holds: ``rows`` (head or None for the entry statement's,
    tuple), statements without tuples, the part of a tuple that goes on from
    before (``tail_of``) and of one that goes on after it (``begun``), the
    entry statement's head part, and the head open at the end."""

    rows: list[tuple[str | None, str]]
    statements: list[str]
    tail_of: str | None = None
    begun: str | None = None
    entry_part: str = ""
    entry_ended: bool = False
    open_head: str | None = None  # of a statement begun here


def cut(text: str, entry: Entry) -> Pieces:
    depth, in_values, own, head, at = entry.depth, entry.in_values, False, [], 0
    out = Pieces([], [])
    start, goes_on = (0, True) if in_values and depth > 0 else (None, False)
    found, _ = events(text, entry.mode)
    for kind, s, e in found:
        if kind == "(":
            if in_values and depth == 0:
                start = s
            depth += 1
        elif kind == ")":
            depth -= 1
            if in_values and depth == 0 and start is not None:
                if goes_on:
                    out.tail_of, goes_on = text[start:e], False
                else:
                    out.rows.append(("".join(head) if own else None, text[start:e]))
                start, at = None, e
        elif kind == "V":
            if depth == 0 and not in_values:
                in_values = True
                head.append(text[at:e])
        else:
            if not in_values:
                head.append(text[at:s])
            if not own:
                out.entry_part, out.entry_ended = "".join(head), not in_values
            elif not in_values:
                out.statements.append("".join(head))
            depth, in_values, own, head, at = 0, False, True, [], e
    if not in_values:
        head.append(text[at:])
    if start is not None:
        if goes_on:
            out.tail_of = text
        else:
            out.begun = text[start:]
    if own:
        out.open_head = "".join(head)
    else:
        out.entry_part = "".join(head)
    return out




def insert_target(head: str) -> tuple[str, list[str] | None] | None:
    """Table and column list (None: all, in order) of an INSERT head."""
    parts = ddl.tokens(head)
    words = [p.upper() for p in parts]
    if not words or words[0] not in ("INSERT", "REPLACE") or words[-1] not in ("VALUES", "VALUE"):
        return None
    at = words.index("INTO") + 1 if "INTO" in words else 1
    name = ddl.bare_name(parts[at])
    while parts[at + 1] == ".":
        at += 2
        name = ddl.bare_name(parts[at])
    listed = [ddl.bare_name(p) for p in parts[at + 1:-1] if p not in ("(", ")", ",")]
    return name, listed or None


_CHUNKS = "path string, block long, no long, text string"
_PIECES = "chunk long, kind string, table_name string, columns array<string>, text string"


def _rows(batch: pa.RecordBatch, at_once: int = 1) -> Iterator[tuple]:
    """The rows of a batch, so many of them as Python values at once."""
    for s in range(0, batch.num_rows, at_once):
        yield from zip(*[c.slice(s, at_once).to_pylist() for c in batch.columns])


def _chunked(lines: DataFrame, chunk_lines: int | None) -> DataFrame:
    """``(path, block, no, text)`` of runs of lines of one file block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, size, no = None, [], 0, 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([where[0]]), pa.array([where[1]], pa.int64()), pa.array([no], pa.int64()),
                                               pa.array(["\n".join(held) + "\n"])], names=["path", "block", "no", "text"])
        for batch in batches:
            for line, path, block in _rows(batch, LINES):
                if held and ((path, block) != where or len(held) == chunk_lines or size >= CHUNK_BYTES):
                    yield chunk()
                    no = no + 1 if (path, block) == where else 0
                    held, size = [], 0
                where = (path, block)
                held.append(line)
                size += len(line) + 1
        if held:
            yield chunk()
    return lines.mapInArrow(run, _CHUNKS)


class ForeignDump:
    """One SQL text. ``path``: a file, a folder or a glob; several files are
    one text in the order of their paths. ``chunk_lines`` bounds the lines of
    a chunk besides ``CHUNK_BYTES``; it never changes the rows. Without
    ``rows`` the whole text is read, but only its statements are kept."""

    def __init__(self, spark: SparkSession, path: str, chunk_lines: int | None = None, glob: str | None = None, rows: bool = True) -> None:
        ship_package(spark)
        reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", glob) if glob else reader
        lines = reader.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
        self.spark, at = spark, scratch_path(spark, "foreign-chunks")
        _chunked(lines, chunk_lines).write.options(**_GROUPS).parquet(at)  # staged: both passes must see the same chunks
        self.rows = rows
        self.chunks = spark.read.schema(_CHUNKS).parquet(at)
        self._find_entries()
        self._cut_all()

    def _find_entries(self) -> None:
        shape = "after int, ended boolean, depth int, in_values boolean, relative array<int>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["after", "ended", "depth", "in_values", "relative"]
            kind = pa.list_(pa.struct(list(zip(names, [pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]))))
            for batch in batches:
                maps = [[dict(zip(names, m)) for m in chunk_map(t)] for *_, t in _rows(batch)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(maps, kind)], names=["path", "block", "no", "maps"])
        maps = self.chunks.mapInArrow(run, f"path string, block long, no long, maps array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>")
        entry, rows = Entry(), []
        for i, r in enumerate(sorted(maps.collect(), key=lambda r: (r.path, r.block, r.no))):  # one row per chunk
            rows.append((r.path, r.block, r.no, i, entry.mode, entry.depth, entry.in_values))
            entry = compose(entry, [tuple(m) for m in r.maps])
        self.entries = self.spark.createDataFrame(rows, "p string, b long, n long, chunk long, mode int, depth int, in_values boolean")
        self.count = len(rows)

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.count <= BROADCAST_CHUNKS else df

    def _cut_all(self) -> None:
        c, e = self.chunks, self._small(self.entries)
        known = c.join(e, (c.path == e.p) & (c.block == e.b) & (c.no == e.n)).select("chunk", "mode", "depth", "in_values", "text")

        keep = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, mode, depth, in_values, text in _rows(batch):
                    p, targets = cut(text, Entry(mode, depth, in_values)), {}
                    rows = []
                    for head, row in p.rows if keep else []:
                        if head is not None and head not in targets:
                            targets[head] = insert_target(head)
                        rows.append(("row" if head is not None else "entry row", *(targets.get(head) or (None, None)), row))
                    rows += [("statement", None, None, s) for s in p.statements]
                    rows += [(k, None, None, v) for k, v in (("tail", p.tail_of), ("begun", p.begun), ("head", p.open_head)) if v is not None and (keep or k == "head")]
                    rows.append(("ended" if p.entry_ended else "entry", None, None, p.entry_part))
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array(cols[0]), pa.array(cols[1], pa.string()),
                                                      pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())],
                                                     names=["chunk", "kind", "table_name", "columns", "text"])
        at = scratch_path(self.spark, "foreign-pieces")
        known.mapInArrow(run, _PIECES).write.partitionBy("kind").parquet(at)
        self.pieces = self.spark.read.schema(_PIECES).parquet(at)
        # heads and open tuples, handed from chunk to chunk: one row per chunk, and statements that cross chunks
        small = (self.pieces.filter(F.col("kind").isin("head", "entry", "ended"))
                 .select("chunk", "kind", "text").unionByName(self.pieces.filter(F.col("kind").isin("begun", "tail")).select("chunk", "kind", F.lit("").alias("text"))))
        by_chunk: list[dict[str, str]] = [{} for _ in range(self.count)]
        for r in small.collect():
            by_chunk[r.chunk][r.kind] = r.text
        head, opened, context, crossing = "", -1, [], []
        for i, got in enumerate(by_chunk):
            before, opened_before = head + got.get("entry", got.get("ended", "")), opened
            if "ended" in got:
                crossing.append(before)
            head = got.get("head", before)
            opened = i if "begun" in got else opened
            context.append((i, *(insert_target(before) or (None, None)), opened_before, *(insert_target(head) or (None, None))))
        self.context = self.spark.createDataFrame(
            context, "at long, t string, cols array<string>, opened long, t_end string, cols_end array<string>")
        self.crossing = crossing

    def create_statements(self) -> DataFrame:
        """``statement``: the CREATE TABLE statements of the text."""
        found = self.pieces.filter("kind = 'statement'").select(F.col("text").alias("statement"))
        if self.crossing:
            found = found.unionByName(self.spark.createDataFrame([(x,) for x in self.crossing], "statement string"))
        return found.filter(F.col("statement").rlike(r"(?is)\bCREATE\s+(?:TEMPORARY\s+)?TABLE\b"))

    def definitions(self) -> dict[str, ddl.Table]:
        """The tables the text creates; the last definition of a name counts."""
        parsed = [ddl.parse_create(r.statement) for r in self.create_statements().collect()]  # bounded by the schema
        return {t.name: t for t in parsed if t is not None}

    def tuples(self) -> DataFrame:
        """``table_name, columns, text``: every tuple, as written."""
        if not self.rows:
            raise ValueError("this text was read without its rows")
        rows = self.pieces.filter("kind = 'row'").select("table_name", "columns", "text")
        ctx = self._small(self.context)
        of_entry = (self.pieces.filter("kind = 'entry row'").select("chunk", "text").join(ctx, F.col("chunk") == F.col("at"))
                    .select(F.col("t").alias("table_name"), F.col("cols").alias("columns"), "text"))
        # a tuple that crosses chunks is known by the chunk it begins in
        parts = (self.pieces.filter(F.col("kind").isin("begun", "tail")).select("chunk", "kind", "text")
                 .join(ctx, F.col("chunk") == F.col("at"))
                 .select(F.when(F.col("kind") == "begun", F.col("chunk")).otherwise(F.col("opened")).alias("first"), "chunk", "text"))
        whole = parts.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("p"))
        joined = (whole.join(ctx, F.col("first") == F.col("at"))
                  .select(F.col("t_end").alias("table_name"), F.col("cols_end").alias("columns"),
                          F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
        return rows.unionByName(of_entry).unionByName(joined)

    def table(self, definition: ddl.Table) -> DataFrame:
        """Typed rows of one table, in the columns of its definition."""
        return typed_rows(self.tuples().filter(F.col("table_name") == definition.name), definition)


# One literal of a tuple; possessive, so long values do not overflow the regex stack.
LITERAL = (r"(?is)(?:_[a-z0-9]++\s*+|n)?'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|" r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|'
           r"x'[0-9a-f]*+'|b'[01]*+'|0x[0-9a-f]*+|\bnull\b|\btrue\b|\bfalse\b|[-+]?(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:e[-+]?[0-9]++)?")


def quoted_value(tok: Column) -> Column:
    """The text of a quoted literal: introducer and quotes off, doubled quotes
    and escapes undone, an unknown escape is its second character. A literal
    without quotes is its own text."""
    bare = F.regexp_replace(tok, r"(?is)\A(?:_[a-z0-9]+\s*|n)(?=')", "")
    quote = F.substring(bare, 1, 1)
    body = bare.substr(F.lit(2), F.length(bare) - 2)
    body = F.when(quote == "'", F.replace(body, F.lit("''"), F.lit("'"))).otherwise(F.replace(body, F.lit('""'), F.lit('"')))

    def fix(p: Column) -> Column:
        for esc, raw in (("\\0", "\x00"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\Z", "\x1a")):
            p = F.replace(p, F.lit(esc), F.lit(raw))
        return F.replace(p, F.lit("\\"), F.lit(""))
    undone = F.array_join(F.transform(F.split(body, r"\\\\", -1), fix), "\\")
    return F.when(quote.isin("'", '"'), undone).otherwise(tok)


def value(tok: Column, dtype: T.DataType) -> Column:
    """Typed value of a literal; null for NULL and for a missing one."""
    low = F.lower(tok)
    if isinstance(dtype, T.BinaryType):
        hexes = F.when(low.startswith("0x"), tok.substr(F.lit(3), F.length(tok))).when(low.startswith("x'"), tok.substr(F.lit(3), F.length(tok) - 3))
        val = F.coalesce(F.unhex(hexes), F.encode(quoted_value(tok), "utf-8"))
    elif isinstance(dtype, T.BooleanType):
        val = low.isin("1", "true", "b'1'", "'1'")
    elif isinstance(dtype, T.TimestampType):
        val = from_utc_text(quoted_value(tok))
    elif isinstance(dtype, T.StringType):
        val = quoted_value(tok)
    else:
        val = F.when(low.startswith("b'"), F.conv(tok.substr(F.lit(3), F.length(tok) - 3), 2, 10)).otherwise(quoted_value(tok)).cast(dtype)
    return F.when(tok.isNull() | (low == "null"), F.lit(None).cast(dtype)).otherwise(val)


def typed_rows(tuples: DataFrame, definition: ddl.Table) -> DataFrame:
    """Rows of ``tuples(columns, text)`` in the types of the definition. A tuple
    with the wrong number of values is an error; a column that an INSERT does
    not list is null."""
    names = F.array(*[F.lit(c.name) for c in definition.columns])
    toks = tuples.select(F.coalesce("columns", names).alias("c"), F.regexp_extract_all("text", F.lit(LITERAL), 0).alias("t"))
    bad = F.raise_error(F.concat(F.lit("bad tuple: "), F.size("t").cast("string"), F.lit(" values, expected "), F.size("c").cast("string")))
    checked = toks.select("c", F.when(F.size("t") == F.size("c"), F.col("t")).otherwise(bad.cast("array<string>")).alias("t"))
    at = lambda c: F.get("t", (F.array_position("c", F.lit(c.name)) - 1).cast("int"))
    return checked.select(*[value(at(c), c.spark_type()).alias(c.name) for c in definition.columns])


def restore_foreign(spark: SparkSession, path: str, chunk_lines: int | None = None, glob: str | None = None) -> dict[str, DataFrame]:
    """Typed DataFrames of every table that a foreign SQL text creates."""
    text = ForeignDump(spark, path, chunk_lines, glob)
    return {name: text.table(t) for name, t in sorted(text.definitions().items())}


def ddl_schema(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``table_name, ordinal, name, data_type, column_type, nullable`` of every
    column, from the CREATE TABLE statements of a text alone."""
    rows = [(t.name, i, c.name, c.data_type, c.column_type, c.nullable)
            for t in ForeignDump(spark, path, glob=glob, rows=False).definitions().values() for i, c in enumerate(t.columns, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, name string, data_type string, column_type string, nullable boolean")
