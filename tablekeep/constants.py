"""Fixed values.

Everything in this module is a value that must be reproduced exactly for the
export text, the object keys and the report labels to come out right. They are
kept together, in natural order, as plain text.
"""

# --- Fixed values: dump text -------------------------------------------------
DUMP_TITLE = "-- tablekeep database dump"
DUMP_GENERATED = "-- Generated: "
DUMP_SESSION_LINES = "SET NAMES utf8mb4;\nSET FOREIGN_KEY_CHECKS=0;\n"
DUMP_FOOTER = "SET FOREIGN_KEY_CHECKS=1;"
INSERT_TUPLE_SEPARATOR = ",\n"
VALUE_SEPARATOR = ", "
NULL_LITERAL = "NULL"
DEFAULT_CHUNK_ROWS = 1000
# Names of the gzip levels in the codec's setting.
GZIP_LEVELS = {1: "BEST_SPEED", 2: "TWO", 3: "THREE", 4: "FOUR", 5: "FIVE", 6: "SIX", 7: "SEVEN", 8: "EIGHT", 9: "BEST_COMPRESSION"}

# The seven characters a MySQL-compatible string escape rewrites, in the order
# applied (the backslash must go first).
STRING_ESCAPES = [
    ("\\", "\\\\"),
    ("\x00", "\\0"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("'", "\\'"),
    ('"', '\\"'),
    ("\x1a", "\\Z"),
]

# Text accepted as a numeric literal.
NUMERIC_PATTERN = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

# --- Fixed values: object keys -----------------------------------------------
BACKUP_FOLDER = "backups/database/"
BACKUP_FOLDER_INNER = "/backups/database/"
BACKUP_FILE_PREFIX = "db-"
BACKUP_FILE_SUFFIX = ".sql.gz"
SAFE_NAME_PATTERN = "[^A-Za-z0-9._-]"
SAFE_NAME_FALLBACK = "database"
KEY_DATE_PATH = "yyyy/MM/dd"
KEY_TIMESTAMP = "yyyyMMdd-HHmmss"
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ssxxx"
DISPLAY_PATTERN = "yyyy-MM-dd HH:mm"  # and the abbreviation of the zone

# --- Fixed values: schedule, lock and history --------------------------------
DAILY_RUN_HOUR = 3
LOCK_SECONDS = 30 * 60
HISTORY_LENGTH = 20
SCHEDULE_DISABLED = "disabled"
SCHEDULE_DAILY = "daily"
SCHEDULE_VALUES = ["disabled", "daily"]
SETTING_KEY_STRIP = "[^a-z0-9_\\-]"
KEEP_DISABLED = 0
KEEP_COUNT_PATTERN = r"\+?[1-9][0-9]*|0"  # the whole text
# Characters trimmed from settings, prefixes and keys.
TRIM_CHARACTERS = " \t\n\r\0\x0b"
MAX_KEEP = 9223372036854775807

# --- Fixed values: labels and messages ---------------------------------------
LABEL_SUCCESS = "Success"
LABEL_FAILED = "Failed"
LABEL_DAILY = "Daily"
LABEL_DISABLED = "Disabled"
LABEL_KEEP_LAST = "Keep last %d"
LABEL_NONE = "None"
LABEL_UNKNOWN = "Unknown"
LABEL_MISSING = "-"
OBJECT_URI = "s3://%s/%s"

MSG_AUTO_OK = "Automatic backup completed successfully."
MSG_AUTO_FAILED = "Automatic database backup failed."
MSG_MANUAL_OK = "Backup completed successfully."
MSG_MANUAL_FAILED = "Database backup failed."
MSG_MANUAL_MISSING = "AWS region and S3 bucket are required."
MSG_SETTINGS_MISSING = "Automatic backup skipped because S3 configuration is incomplete."
BACKEND_UNKNOWN = "unknown"
MSG_RETENTION_NONE = "Retention: keeping the latest %d backups; no old backups required deletion."
MSG_RETENTION_DELETED = "Retention: deleted %d old backup(s), keeping the latest %d."
MSG_RETENTION_FAILED = "Retention cleanup failed; the new backup was preserved."

ERR_UPLOAD_DENIED = "Access denied while uploading backup to Amazon S3."
ERR_BUCKET_MISSING = "The configured S3 bucket was not found."
ERR_UPLOAD_OTHER = "Amazon S3 backup upload failed."
ERR_TEST_DENIED = "Access denied while testing S3 object operations."
ERR_TEST_OTHER = "Unable to complete the S3 connection test."
ERR_DENIED_CODE = "AccessDenied"
ERR_BUCKET_CODE = "NoSuchBucket"

# Size units of a human-readable byte count, powers of 1024.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
