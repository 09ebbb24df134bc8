"""The one logical table, an operation log of versioned keys, and its fixed sizes."""

from pyspark.sql import types as T

PUT, DELETE = 1, 0
LEVELS = 7
#: Flush threshold, level-1 bytes, growth a level, level-0 files that call for compaction, restart interval, log block, fragment header.
FLUSH_BYTES, LEVEL_BYTES, LEVEL_GROWTH, L0_FILES, RESTART, LOG_BLOCK, LOG_HEADER = 4 << 20, 10 << 20, 10, 4, 16, 32768, 7



def oplog_of(kind: T.DataType) -> T.StructType:
    """Operations with keys and values of one kind: strings, or bytes of any sort."""
    return T.StructType([T.StructField("user_key", kind, False), T.StructField("seq", T.LongType(), False), T.StructField("type", T.IntegerType(), False), T.StructField("value", kind)])


OPLOG, OPLOG_BINARY = oplog_of(T.StringType()), oplog_of(T.BinaryType())


class StoreError(Exception):
    """Base of this library's errors."""


class NotFound(StoreError):
    pass


class Corruption(StoreError):
    pass


class IOFailure(StoreError):
    pass


class Conflict(IOFailure):
    """Another writer has committed since this handle looked; open the store again."""


class InvalidArgument(StoreError):
    pass
