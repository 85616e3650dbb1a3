"""Restore from SQL text of another writer, and CREATE TABLE text."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tablekeep.functions import ddl
from tablekeep.sources import foreign
from tablekeep.sources.foreign import Entry, chunk_map, compose, cut

TEXT = """-- a dump; with 'quotes' in a comment (
/*!40101 SET NAMES utf8mb4 */; /* a; 'comment
( over lines */
# another; comment '
DROP TABLE IF EXISTS `it``em`;
CREATE TABLE IF NOT EXISTS `shop`.`it``em` (
  `id` int(11) unsigned NOT NULL AUTO_INCREMENT,
  `na,me` varchar(40) CHARACTER SET utf8mb4 COLLATE utf8mb4_bin DEFAULT 'a,''b);' COMMENT 'the; (name',
  price decimal(10,2) DEFAULT NULL, -- trailing, comment
  flag tinyint(1) NOT NULL DEFAULT '0',
  data longblob,
  made timestamp(6) NULL DEFAULT CURRENT_TIMESTAMP(6) ON UPDATE CURRENT_TIMESTAMP(6),
  kind enum('a','b;'),
  PRIMARY KEY (`id`),
  UNIQUE KEY `u` (`na,me`(10),price DESC),
  CONSTRAINT `f` FOREIGN KEY (`kind`) REFERENCES `kinds` (`k`)
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;
INSERT INTO `it``em`
  (`id`, `na,me`,
   price)
VALUES
(1, 'plain', 1.50),
(2, 'two
lines; with (brackets) and ''quotes'' and \\'escapes\\' and \\\\', -2e1),
(3, NULL, NULL);
INSERT INTO `it``em` VALUES (4,'tab\\t\\%x',0.1,1,0x00ff,'2024-05-06 07:08:09.5','a'),(5,_utf8mb4 'é
-- not a comment
/* nor this',12,true,X'4142','2024-01-01 00:00:00',"b;"),(6,'',.5,0,_binary 'ab\\0',NULL,NULL);
CREATE TABLE empty_one (x bigint);
"""
ROWS = [(1, "plain", Decimal("1.50"), False, None, None, None), (2, "two\nlines; with (brackets) and 'quotes' and 'escapes' and \\", Decimal(-20), False, None, None, None),
        (3, None, None, False, None, None, None), (4, "tab\t%x", Decimal("0.10"), True, b"\x00\xff", "2024-05-06 07:08:09.5", "a"),
        (5, "é\n-- not a comment\n/* nor this", Decimal(12), True, b"AB", "2024-01-01 00:00:00", "b;"), (6, "", Decimal("0.50"), False, b"ab\x00", None, None)]


def write(tmp_root, text, name="dump.sql"):
    with open(f"{tmp_root}/{name}", "w", newline="") as f:
        f.write(text)
    return f"{tmp_root}/{name}"


def rows_of(df):
    out = [tuple(r) for r in df.withColumn("made", df.made.cast("string")).collect()]
    return sorted((r[0], r[1], r[2], bool(r[3]), None if r[4] is None else bytes(r[4]), r[5], r[6]) for r in out)


@pytest.mark.parametrize("lines", [1, 2, 3, 7, None])
def test_any_chunk_size_gives_the_same_rows(spark, tmp_root, lines):
    got = foreign.restore_foreign(spark, write(tmp_root, TEXT), lines)
    assert sorted(got) == ["empty_one", "it`em"]
    assert rows_of(got["it`em"]) == ROWS
    assert got["empty_one"].count() == 0 and got["empty_one"].schema["x"].dataType == T.LongType()
    assert [f.dataType for f in got["it`em"].schema] == [T.LongType(), T.StringType(), T.DecimalType(10, 2), T.BooleanType(), T.BinaryType(),
                                                         T.TimestampType(), T.StringType()]


def test_several_files_are_one_text(spark, tmp_root):
    lines = TEXT.split("\n")
    for i in range(0, len(lines), 5):
        write(tmp_root, "\n".join(lines[i:i + 5]) + "\n", f"part-{i:03d}.sql")
    assert rows_of(foreign.restore_foreign(spark, tmp_root, glob="*.sql")["it`em"]) == ROWS


def test_wrong_number_of_values_is_an_error(spark, tmp_root):
    path = write(tmp_root, "CREATE TABLE t (a int, b int);\nINSERT INTO t (a, b) VALUES (1, 2), (3);\n")
    with pytest.raises(Exception, match="bad tuple"):
        foreign.restore_foreign(spark, path)["t"].collect()


def test_empty_and_statement_free_texts(spark, tmp_root):
    assert foreign.restore_foreign(spark, write(tmp_root, "")) == {}
    assert foreign.restore_foreign(spark, write(tmp_root, "-- nothing here", "b.sql")) == {}


def whole_entry(text):
    entry = Entry()
    for kind, _, _ in foreign.events(text, 0)[0]:
        if kind == ";":
            entry = Entry()
        elif kind == "V":
            entry = Entry(0, entry.depth, entry.in_values or entry.depth == 0)
        else:
            entry = Entry(0, entry.depth + (1 if kind == "(" else -1), entry.in_values)
    return Entry(foreign.events(text, 0)[1], entry.depth, entry.in_values)


def test_composed_maps_equal_one_long_read():
    rng = random.Random(7)
    bits = ["'", "''", "\\'", "\\\\", '"', "`", "(", ")", ";", "-- x", "/*", "*/", "#", "VALUES", "INSERT INTO t ", ", ", "a", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) + "\n"
        lines = text.split("\n")[:-1]
        entry, at = Entry(), 0
        while at < len(lines):
            n = rng.randint(1, 4)
            piece = "\n".join(lines[at:at + n]) + "\n"
            cut(piece, entry)
            entry, at = compose(entry, chunk_map(piece)), at + n
        assert entry == whole_entry(text)


def test_create_table_round_trip():
    t = ddl.parse_create(TEXT[TEXT.index("CREATE TABLE IF"):TEXT.index("INSERT")])
    assert t.name == "it`em"
    assert [(c.name, c.column_type, c.nullable) for c in t.columns] == [
        ("id", "int(11) unsigned", False), ("na,me", "varchar(40)", True), ("price", "decimal(10,2)", True), ("flag", "tinyint(1)", False),
        ("data", "longblob", True), ("made", "timestamp(6)", True), ("kind", "enum('a','b;')", True)]
    assert t.columns[0].auto_increment and t.columns[1].default == "'a,''b);'" and t.columns[1].comment == "the; (name"
    assert t.columns[1].character_set == "utf8mb4" and t.columns[5].default == "CURRENT_TIMESTAMP(6)"
    assert [(k.kind, k.columns) for k in t.keys] == [("PRIMARY KEY", ["id"]), ("UNIQUE KEY", ["na,me", "price"]), ("FOREIGN KEY", ["kind"])]
    again = ddl.parse_create(ddl.create_text(t))
    assert again == t
    assert ddl.parse_create("INSERT INTO t VALUES (1)") is None
    assert ddl.create_text(ddl.parse_create("create table x (a int primary key, b double precision not null)")).count("NOT NULL") == 2


def test_types_of_columns():
    t = ddl.parse_create("CREATE TABLE t (a tinyint, b smallint unsigned, c mediumint, d bigint unsigned, e float, f double(8,2), g date, h datetime(6), "
                         "i bit(1), j bit(8), k year, l numeric, m time, n json, o varbinary(9), p bool)")
    assert [c.spark_type().simpleString() for c in t.columns] == [
        "tinyint", "int", "int", "decimal(20,0)", "float", "double", "date", "timestamp_ntz", "boolean", "bigint", "int", "decimal(10,0)", "string", "string",
        "binary", "boolean"]


def test_schema_keeps_no_rows_and_chunks_stay_small(spark, tmp_root, monkeypatch):
    kept = []

    class Watched(foreign.ForeignDump):
        def _cut_all(self):
            super()._cut_all()
            kept.append(self)
    monkeypatch.setattr(foreign, "ForeignDump", Watched)
    got = foreign.ddl_schema(spark, write(tmp_root, TEXT)).filter("table_name = 'it`em'").orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(1, 8))
    assert kept[0].pieces.filter("kind in ('row', 'entry row', 'begun', 'tail')").count() == 0
    with pytest.raises(ValueError, match="without its rows"):
        kept[0].tuples()
    # a task stages a chunk at a time, and reads one at a time
    assert foreign.CHUNK_BYTES <= 1 << 20
    write(tmp_root, "INSERT INTO t VALUES\n" + ",\n".join(f"({i}, '{i:0500d}')" for i in range(20_000)) + ";\n", "large.sql")
    text = foreign.ForeignDump(spark, f"{tmp_root}/large.sql")
    assert text.chunks.count() >= 9 and text.chunks.selectExpr("max(length(text))").first()[0] < 1.01 * (1 << 20)


def test_foreign_text_is_written_by_many_tasks(spark, tmp_root):
    import glob

    from tablekeep.plans.transfer_queries import foreign_text
    docs = spark.createDataFrame([(i, f"it's; ({i}\n", "en", None, i) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        foreign_text(docs, f"{tmp_root}/text")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(f"{tmp_root}/text/part-*"))
    assert len(files) > 4 and "CREATE TABLE" in open(files[0]).read()
    assert sorted(map(tuple, foreign.restore_foreign(spark, f"{tmp_root}/text")["documents"].collect())) == sorted(map(tuple, docs.collect()))
