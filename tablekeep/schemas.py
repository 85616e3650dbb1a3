"""Fixed schemas of the tables this library produces and consumes."""

from pyspark.sql import types as T

HISTORY = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("message", T.StringType()),
])

# The keyed record form of one history entry (what a JSON store holds).
HISTORY_RECORD = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("databaseName", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("sizeBytes", T.LongType()),
    T.StructField("message", T.StringType()),
])

COLUMNS = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("column_type", T.StringType()),
    T.StructField("character_set", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("spark_type", T.StringType()),
])

DELETE_RESULT = T.StructType([
    T.StructField("bucket", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("missing", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

# Dump sections, in the order they appear in the text.
SECTION_HEADER = 0
SECTION_CREATE = 1
SECTION_INSERT = 2
SECTION_FOOTER = 3
