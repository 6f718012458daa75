"""Names, keys and prefixes of namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.errors import InvalidInputError

SEPARATOR = "::"
MAX_NAME_BYTES = 255


def parse_name(name: str, separator: str = SEPARATOR) -> str:
    if not name:
        raise InvalidInputError("a namespace must not be empty")
    if separator in name:
        raise InvalidInputError("a namespace must not contain the separator")
    if "\0" in name:
        raise InvalidInputError("a namespace must not contain NUL")
    if len(name.encode()) > MAX_NAME_BYTES:
        raise InvalidInputError(f"a namespace has at most {MAX_NAME_BYTES} bytes")
    return name


def name_ok(col: str, separator: str = SEPARATOR) -> Column:
    v = F.col(col)
    ok = (v != "") & ~v.contains(separator) & ~v.contains("\0") & (F.octet_length(v) <= MAX_NAME_BYTES)
    return F.coalesce(ok, F.lit(False))


def key(namespace: Column | str, object_id: Column | str, separator: str = SEPARATOR) -> Column:
    return F.concat(namespace, F.lit(separator), object_id)


def prefix(namespace: str, separator: str = SEPARATOR) -> str:
    return namespace + separator


def owns_key(namespace: str, k: Column | str, separator: str = SEPARATOR) -> Column:
    return F.startswith(k if isinstance(k, Column) else F.col(k), F.lit(prefix(namespace, separator)))


def strip_prefix(namespace: str, k: Column | str, separator: str = SEPARATOR) -> Column:
    """The key without the namespace's prefix, null if it belongs to another one."""
    c = k if isinstance(k, Column) else F.col(k)
    return F.when(owns_key(namespace, c, separator), F.substring(c, len(prefix(namespace, separator)) + 1, 2**31 - 1))


def parse_key(k: Column | str, separator: str = SEPARATOR) -> Column:
    """struct(namespace, object_id), cut at the first separator; null where there is none."""
    c = k if isinstance(k, Column) else F.col(k)
    at = F.instr(c, separator)
    head = F.substring(c, F.lit(1), at - 1)
    tail = F.substring(c, at + len(separator), F.length(c))
    return F.when(at > 0, F.struct(head.alias("namespace"), tail.alias("object_id")))


def extract_namespaces(df: DataFrame, k: str, separator: str = SEPARATOR) -> DataFrame:
    """Distinct namespaces of a column of keys, sorted."""
    ns = df.select(parse_key(k, separator).getField("namespace").alias("namespace"))
    return ns.where(F.col("namespace").isNotNull()).distinct().orderBy("namespace")


def counts(current: DataFrame) -> DataFrame:
    """namespace, objects."""
    return current.groupBy("namespace").agg(F.count("*").alias("objects"))
