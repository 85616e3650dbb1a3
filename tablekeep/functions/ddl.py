"""CREATE TABLE text: read into column and key definitions, and written back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .literals import quote_identifier_text

_TOKEN = re.compile(r"""`(?:[^`]|``)*`|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--\s[^\n]*|\#[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|[-+]?\d[\w.]*|[^\s]""", re.S)
_KEY_WORDS = {"PRIMARY", "UNIQUE", "KEY", "INDEX", "FULLTEXT", "SPATIAL", "CONSTRAINT", "FOREIGN", "CHECK"}
_BLOBS = {"binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob"}
_WHOLE = {"tinyint": (T.ByteType, T.ShortType), "smallint": (T.ShortType, T.IntegerType), "mediumint": (T.IntegerType, T.IntegerType),
          "int": (T.IntegerType, T.LongType), "integer": (T.IntegerType, T.LongType), "year": (T.IntegerType, T.IntegerType)}


@dataclass
class Column:
    name: str
    data_type: str
    column_type: str
    nullable: bool = True
    character_set: str | None = None
    default: str | None = None  # as written; None: no default
    auto_increment: bool = False
    comment: str | None = None
    rest: str = ""  # other attributes, as written

    def spark_type(self) -> T.DataType:
        """The type a restore gives the column."""
        unsigned = "unsigned" in self.column_type
        args = [int(x) for x in re.findall(r"\d+", self.column_type.partition("(")[2])]
        if self.column_type in ("tinyint(1)", "bool", "boolean", "bit(1)", "bit"):
            return T.BooleanType()
        if self.data_type in _WHOLE:
            return _WHOLE[self.data_type][unsigned]()
        if self.data_type == "bigint":
            return T.DecimalType(20, 0) if unsigned else T.LongType()
        if self.data_type in ("decimal", "numeric", "dec", "fixed"):
            return T.DecimalType(*(args or [10])[:1], (args + [0, 0])[1])
        simple = {"float": T.FloatType, "double": T.DoubleType, "real": T.DoubleType, "date": T.DateType,
                  "datetime": T.TimestampNTZType, "timestamp": T.TimestampType, "bit": T.LongType}
        if self.data_type in simple:
            return simple[self.data_type]()
        return T.BinaryType() if self.data_type in _BLOBS else T.StringType()


@dataclass
class Key:
    kind: str  # PRIMARY KEY, UNIQUE KEY, KEY, FOREIGN KEY, CHECK, ...
    columns: list[str]
    text: str  # as written


@dataclass
class Table:
    name: str
    columns: list[Column]
    keys: list[Key] = field(default_factory=list)
    options: str = ""

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), c.nullable) for c in self.columns])


def bare_name(token: str) -> str:
    """A name without its quotes."""
    if token[:1] in "`\"" and token[-1:] == token[:1] and len(token) > 1:
        return token[1:-1].replace(token[0] * 2, token[0])
    return token


def text_value(token: str) -> str:
    """A quoted text without quotes and escapes."""
    plain = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a", "b": "\b"}
    body = token[1:-1].replace(token[0] * 2, token[0])
    return re.sub(r"\\(.)", lambda m: plain.get(m[1], m[1]), body, flags=re.S)


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not (t.startswith(("-- ", "--\n", "--\t", "#")) or (t.startswith("/*") and not t.startswith("/*!")))]


def _spaced(parts: list[str]) -> str:
    return re.sub(r"\s*([(),])\s*", lambda m: {",": ","}.get(m[1], m[1]), " ".join(parts)) if parts else ""


def _column(parts: list[str]) -> Column:
    name, kind, at = bare_name(parts[0]), parts[1].lower(), 2
    shape = kind
    if kind == "double" and parts[at:at + 1] and parts[at].upper() == "PRECISION":
        at += 1
    if parts[at:at + 1] == ["("]:
        end = parts.index(")", at)
        shape += "(" + ",".join(p for p in parts[at + 1:end] if p != ",") + ")"
        at = end + 1
    out, rest = Column(name, kind, shape), []
    while at < len(parts):
        word = parts[at].upper()
        after = parts[at + 1].upper() if at + 1 < len(parts) else ""
        if word in ("UNSIGNED", "ZEROFILL"):
            out.column_type += " " + word.lower()
        elif word == "NOT" and after == "NULL":
            out.nullable, at = False, at + 1
        elif word == "NULL":
            pass
        elif word in ("CHARSET", "CHARACTER"):
            at += 1 + (word == "CHARACTER")
            out.character_set = bare_name(parts[at])
        elif word == "COLLATE":
            rest += ["COLLATE", parts[at + 1]]
            at += 1
        elif word == "DEFAULT":
            out.default, at = parts[at + 1], at + 1
            if parts[at + 1:at + 2] == ["("]:  # a call
                end = parts.index(")", at)
                out.default += _spaced(parts[at + 1:end + 1])
                at = end
        elif word == "AUTO_INCREMENT":
            out.auto_increment = True
        elif word == "COMMENT":
            out.comment, at = text_value(parts[at + 1]), at + 1
        elif word == "PRIMARY" and after == "KEY":
            out.nullable, at = False, at + 1
            rest += ["PRIMARY", "KEY"]
        else:
            rest.append(parts[at])
        at += 1
    out.rest = _spaced(rest)
    return out


def _key(parts: list[str]) -> Key:
    words = [p.upper() for p in parts]
    at = 2 if words[0] == "CONSTRAINT" and words[1] not in _KEY_WORDS else int(words[0] == "CONSTRAINT")
    kind = words[at] + (" KEY" if words[at] in ("PRIMARY", "UNIQUE", "FOREIGN", "FULLTEXT", "SPATIAL") else "")
    kind = "KEY" if kind == "INDEX" else kind
    names: list[str] = []
    if kind != "CHECK" and "(" in parts:
        depth, start = 0, parts.index("(")
        for p in parts[start:]:
            depth += (p == "(") - (p == ")")
            if depth == 0:
                break
            if depth == 1 and p not in "(,)":
                if p.upper() not in ("ASC", "DESC"):
                    names.append(bare_name(p))
    return Key(kind, names, _spaced(parts))


def parse_create(sql: str) -> Table | None:
    """The table a CREATE TABLE statement defines; None for other statements."""
    parts = tokens(sql)
    words = [p.upper() for p in parts[:8]]
    if words[:1] != ["CREATE"] or "TABLE" not in words[:3] or "(" not in parts:
        return None
    at = words.index("TABLE") + 1
    if words[at:at + 3] == ["IF", "NOT", "EXISTS"]:
        at += 3
    name = bare_name(parts[at])
    while parts[at + 1] == ".":  # a database before the name
        at += 2
        name = bare_name(parts[at])
    depth, item, items, n = 0, [], [], parts.index("(", at)
    for n in range(n, len(parts)):  # noqa: B020
        p = parts[n]
        depth += p == "("
        depth -= p == ")"
        if depth == 0 or (depth == 1 and p == ","):
            items.append(item)
            item = []
            if depth == 0:
                break
        elif not (depth == 1 and p == "("):
            item.append(p)
    table = Table(name, [], [], _spaced([p for p in parts[n + 1:] if p != ";"]))
    for item in items:
        if item and item[0].upper() in _KEY_WORDS:
            table.keys.append(_key(item))
        elif item:
            table.columns.append(_column(item))
    primary = {c for k in table.keys if k.kind == "PRIMARY KEY" for c in k.columns}
    for c in table.columns:
        c.nullable = c.nullable and c.name not in primary
    return table


def create_text(table: Table) -> str:
    """CREATE TABLE text of a definition, columns and keys in their order."""
    lines = []
    for c in table.columns:
        line = f"  {quote_identifier_text(c.name)} {c.column_type}"
        line += f" CHARACTER SET {c.character_set}" if c.character_set else ""
        line += "" if c.nullable else " NOT NULL"
        line += f" DEFAULT {c.default}" if c.default is not None else ""
        line += " AUTO_INCREMENT" if c.auto_increment else ""
        line += f" {c.rest}" if c.rest else ""
        if c.comment is not None:
            line += " COMMENT '" + c.comment.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"
        lines.append(line)
    lines += [f"  {k.text}" for k in table.keys]
    return f"CREATE TABLE {quote_identifier_text(table.name)} (\n" + ",\n".join(lines) + "\n)" + (f" {table.options}" if table.options else "")
