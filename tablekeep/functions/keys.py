"""Object keys: building, normalising and recognising backup keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Every Latin-1 character that the safe-name pattern does not allow.
_UNSAFE = "".join(chr(i) for i in range(256) if re.match(K.SAFE_NAME_PATTERN, chr(i)))


def safe_name(c) -> Column:
    """Every *byte* outside ``[A-Za-z0-9._-]`` becomes ``_``, so a
    three-byte character gives three underscores; empty gives ``database``.
    Re-reading the UTF-8 bytes as Latin-1 makes each byte one character."""
    latin = F.decode(F.encode(_col(c), "UTF-8"), "ISO-8859-1")
    out = F.translate(latin, _UNSAFE, "_" * len(_UNSAFE))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(K.SAFE_NAME_FALLBACK)).otherwise(out)


def normalise_prefix(c) -> Column:
    """C11: white space and NUL trimmed, then ``/`` trimmed on both sides; ``''`` means
    no prefix. One rule for writing and for listing (the part ``0`` is kept)."""
    return F.btrim(F.btrim(F.coalesce(_col(c), F.lit("")), F.lit(K.TRIM_CHARACTERS)), F.lit("/"))


def normalise_key(c) -> Column:
    """White space and NUL trimmed, leading ``/`` removed."""
    return F.ltrim(F.btrim(_col(c), F.lit(K.TRIM_CHARACTERS)), F.lit("/"))


def backup_prefix(prefix) -> Column:
    """``<prefix>/backups/database/`` or ``backups/database/``."""
    p = normalise_prefix(prefix)
    return F.when(p == "", F.lit(K.BACKUP_FOLDER)).otherwise(F.concat(p, F.lit("/" + K.BACKUP_FOLDER)))


def backup_file_name(name, ts) -> Column:
    return F.concat(F.lit(K.BACKUP_FILE_PREFIX), safe_name(name), F.lit("-"),
                    F.date_format(_col(ts), K.KEY_TIMESTAMP), F.lit(K.BACKUP_FILE_SUFFIX))


def backup_key(prefix, name, ts) -> Column:
    """C13 + D1 + A1: non-empty parts joined by ``/``: prefix, ``backups``,
    ``database``, ``yyyy/MM/dd``, ``db-<safe name>-<yyyyMMdd-HHmmss>.sql.gz``.
    The time is read in the session zone (UTC)."""
    parts = F.array(normalise_prefix(prefix), F.lit("backups"), F.lit("database"),
                    F.date_format(_col(ts), K.KEY_DATE_PATH), backup_file_name(name, ts))
    return F.array_join(F.filter(parts, lambda x: x != ""), "/")


def basename(c) -> Column:
    """C14: last path part after trailing ``/`` are removed."""
    return F.regexp_extract(F.rtrim(_col(c), F.lit("/")), r"[^/]*$", 0)


def _file_ok(key) -> Column:
    b = basename(key)
    return F.startswith(b, F.lit(K.BACKUP_FILE_PREFIX)) & F.endswith(b, F.lit(K.BACKUP_FILE_SUFFIX))


def is_backup_key(key, prefix) -> Column:
    """non-empty key under ``backup_prefix(prefix)`` whose file name is
    ``db-*.sql.gz`` (case-sensitive, no date check)."""
    key = _col(key)
    under = F.startswith(key, backup_prefix(prefix))
    return F.coalesce((key != "") & under & _file_ok(key), F.lit(False))


def is_safe_key(bucket, key) -> Column:
    """the weaker re-check made right before deleting: non-empty bucket
    and key, ``/backups/database/`` anywhere or ``backups/database/`` first,
    and the same file-name rule."""
    bucket, key = _col(bucket), _col(key)
    folder = F.contains(key, F.lit(K.BACKUP_FOLDER_INNER)) | F.startswith(key, F.lit(K.BACKUP_FOLDER))
    return F.coalesce((bucket != "") & (key != "") & folder & _file_ok(key), F.lit(False))


def trim_etag(c) -> Column:
    """Surrounding double quotes removed; missing stays null."""
    return F.btrim(_col(c), F.lit('"'))


def object_uri(bucket, key) -> Column:
    """``s3://bucket/key``, or ``-`` when either part is empty."""
    b, k = F.coalesce(_col(bucket), F.lit("")), F.coalesce(_col(key), F.lit(""))
    return F.when((b == "") | (k == ""), F.lit(K.LABEL_MISSING)) \
        .otherwise(F.format_string(K.OBJECT_URI, b, k))
