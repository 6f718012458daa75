"""Text log and snapshot files: reading tolerates torn and corrupt lines, writing adds a checksum.

A record is ``micros|namespace|id|lat|lon|alt|length|json`` or ``TOMBSTONE|micros|namespace|id``; files of the second
version start with a header and put ``crc32hex|`` before every record.  Metadata may contain ``|``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the file formats.
LOG_HEADER = "#driftline-log v2"
HEADER_PATTERN = r"^#\S+-log v2$"
SNAPSHOT_PATTERN = r"^#\S+-snap v1 (\d+)$"
SNAPSHOT_HEADER = "#driftline-snap v1"
TOMBSTONE = "TOMBSTONE"
#: File splits up to which their table is broadcast.
MAX_BROADCAST_SPLITS = 100_000


def record_text() -> Column:
    """The line body of an update row."""
    us = F.greatest(F.lit(0), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)))
    meta = F.coalesce("metadata", F.lit("null"))
    update = F.concat_ws(
        "|", us.cast("string"), "namespace", "object_id",
        F.format_string("%.6f", "y"), F.format_string("%.6f", "x"), F.format_string("%.6f", "z"),
        F.octet_length(meta).cast("string"), meta,
    )
    gone = F.concat_ws("|", F.lit(TOMBSTONE), us.cast("string"), "namespace", "object_id")
    return F.when(F.col("op") == "T", gone).otherwise(update)


def write_log(updates: DataFrame, path: str, *, partitions: int = 64, header: str = LOG_HEADER) -> None:
    """Writes the rows in seq order as range-partitioned text files; file names sort in seq order.

    The first line of every file is the header, so each file is a complete log.
    """
    body = updates.select("seq", record_text().alias("body"))
    line = F.concat(F.lpad(F.lower(F.hex(F.crc32(F.col("body").cast("binary")))), 8, "0"), F.lit("|"), F.col("body"))
    lines = body.select("seq", line.alias("value")).repartitionByRange(partitions, "seq").sortWithinPartitions("seq")

    def with_header(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        first = True
        for b in batches:
            v = b.column(1)
            if first and b.num_rows:
                v = pa.concat_arrays([pa.array([header], pa.string()), v.cast(pa.string())])
                first = False
            yield pa.RecordBatch.from_arrays([v], names=["value"])

    lines.mapInArrow(with_header, "value string").write.mode("overwrite").text(path)


def parse_lines(lines: DataFrame, *, checked: Column | bool) -> DataFrame:
    """Update rows of a DataFrame with ``value`` and ``seq``; lines that are torn, malformed or fail the checksum drop out.

    ``checked``: whether the line is of the second version.
    """
    df = lines.where(~F.startswith("value", F.lit("#")))
    checked = F.lit(checked) if isinstance(checked, bool) else checked
    crc = F.substring("value", 1, 8)
    body = F.expr("substring(value, 10)")
    whole = F.lpad(F.lower(F.hex(F.crc32(body.cast("binary")))), 8, "0") == F.lower(crc)
    df = df.where(~checked | ((F.substring("value", 9, 1) == "|") & whole)).withColumn("value", F.when(checked, body).otherwise(F.col("value")))
    p = F.split("value", r"\|", 8)
    part = lambda i: F.get(p, F.lit(i))
    gone = part(0) == TOMBSTONE
    us = F.when(gone, part(1)).otherwise(part(0)).try_cast("bigint")
    meta = part(7)
    y, x, z = (part(i).try_cast("double") for i in (3, 4, 5))
    good = F.when(gone, (F.size(p) == 4) & us.isNotNull()).otherwise(
        (F.size(p) == 8) & us.isNotNull() & x.isNotNull() & y.isNotNull() & z.isNotNull()
        & (part(6).try_cast("int") == F.octet_length(meta))
    )
    u = ~gone
    return df.where(F.coalesce(good, F.lit(False))).select(
        F.when(gone, part(2)).otherwise(part(1)).alias("namespace"),
        F.when(gone, part(3)).otherwise(part(2)).alias("object_id"),
        F.when(gone, "T").otherwise("U").alias("op"),
        "seq",
        F.timestamp_micros(us).alias("ts"),
        *[F.when(u, v).alias(k) for k, v in (("x", x), ("y", y), ("z", z))],
        # metadata that is no JSON reads as null
        F.when(u, F.when(F.try_parse_json(meta).isNotNull(), meta).otherwise("null")).alias("metadata"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Update rows of a log (file or folder, version 1 or 2); ``seq`` grows along each file, files in name order.

    The version is each file's own, by its header.  Line numbers come from the position in the input split, so reading is
    parallel and no global sort is needed.
    """
    files = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    rank = sorted({(r.f, r.b) for r in files.select("f", "b").distinct().collect()})  # one entry per file split
    second = {r.f for r in files.where(F.col("value").rlike(HEADER_PATTERN)).select("f").distinct().collect()}  # one entry per file
    table = spark.createDataFrame([(f, b, i, f in second) for i, (f, b) in enumerate(rank)], "f string, b bigint, part bigint, checked boolean")
    numbered = files.withColumn("line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    seq = F.shiftleft(F.col("part"), 33) + F.col("line")
    table = F.broadcast(table) if len(rank) <= MAX_BROADCAST_SPLITS else table
    return parse_lines(numbered.join(table, ["f", "b"]).select("value", seq.alias("seq"), "checked"), checked=F.col("checked"))


def write_text_snapshot(current: DataFrame, path: str, covered: int, *, partitions: int = 64) -> None:
    """Current state as text files of checked records, each headed by what the snapshot covers of the log."""
    rows = current.withColumns({"op": F.lit("U"), "seq": F.coalesce(F.col("seq"), F.lit(0))})
    write_log(rows, path, partitions=partitions, header=f"{SNAPSHOT_HEADER} {covered}")


def read_text_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """(state without seq, covered) of a text snapshot; None if a header is missing or any record is bad, so that all is replayed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f")).where("value <> ''")
    of_header = F.col("value").rlike(SNAPSHOT_PATTERN)
    covered = F.regexp_extract("value", SNAPSHOT_PATTERN, 1).cast("bigint")
    state = parse_lines(lines.where(~of_header).select("value", F.lit(None).cast("bigint").alias("seq")), checked=True)
    files, headers, low, high, records = lines.agg(
        F.count_distinct("f"), F.count_if(of_header), F.min(F.when(of_header, covered)), F.max(F.when(of_header, covered)), F.count_if(~of_header)
    ).first()
    if not files or headers != files or low != high or state.count() != records:
        return None
    return state.drop("op"), low


def write_snapshot(current: DataFrame, path: str, covered_seq: int) -> None:
    """Current state as Parquet, marked with the ``seq`` it covers; a new version never overwrites an old one."""
    current.withColumn("covered_seq", F.lit(covered_seq).cast("bigint")).write.mode("errorifexists").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(state, covered seq); an empty snapshot covers nothing (-1)."""
    df = spark.read.parquet(path)
    row = df.agg(F.max("covered_seq")).first()
    return df.drop("covered_seq"), -1 if row[0] is None else row[0]


def recover(updates: DataFrame, snapshot: DataFrame | None = None, covered_seq: int = -1) -> DataFrame:
    """Current state after a restart: the snapshot and the records behind it; of equal times the first write wins."""
    from driftline.operators.change_feed import replay

    tail = updates.where(F.col("seq") > covered_seq) if snapshot is not None else updates
    return replay(tail, snapshot, tie="first")
