"""Mixing sources to target weights by capped water-filling.

Sizes of the sources are summed map-side; the filling itself works on the few listed sources on the driver.
A source whose target exceeds its size times its cap is clamped there, and what it cannot give is spread over the
others in proportion to their targets, until nothing exceeds a cap.  Each document is then repeated a whole number
of times, and the fractional rest is drawn by a seeded hash of the ids, so the result doesn't depend on the partitioning
and only small totals are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the table of targets that are worked off on the driver.
MAX_SOURCES = 10_000
#: Steps in which a fractional repetition is drawn.
BUCKETS = 4_096


@dataclass
class Share:
    source: str
    target: float
    size: float
    cap: int
    amount: float = 0.0

    @property
    def limit(self) -> float:
        return self.size * self.cap

    @property
    def repeats(self) -> float:
        return min(float(self.cap), self.amount / self.size) if self.size > 0 else 0.0


def fill(shares: list[Share], total: float) -> list[Share]:
    """Sets ``amount`` of each share so that they add up to ``total``, or to all that the caps allow if that is less."""
    free = [s for s in shares if s.target > 0 and s.limit > 0]
    for s in shares:
        s.amount = 0.0
    left = total
    while free and left > 0:
        weight = sum(s.target for s in free)
        over = [s for s in free if left * s.target / weight >= s.limit]
        if not over:
            for s in free:
                s.amount = left * s.target / weight
            break
        for s in over:
            s.amount = s.limit
            left -= s.limit
        gone = {id(s) for s in over}
        free = [s for s in free if id(s) not in gone]
    return shares


def source_key(col: str) -> Column:
    """Case and outer white space of a source's name don't count."""
    return F.lower(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[Share]:
    """Filled shares of the listed sources.  ``sizes``: source, tokens.  ``total`` defaults to the listed sources' size."""
    listed = (
        targets.where(F.col("source").isNotNull())
        .groupBy(source_key("source").alias("source"))
        .agg(
            F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
            F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
        )
    )
    by = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = listed.join(by, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with targets")
    shares = [Share(r["source"], r["target_share"], float(r["tokens"] or 0), r["max_repeats"]) for r in rows]
    shares.sort(key=lambda s: s.source)
    return fill(shares, sum(s.size for s in shares) if total is None else total)


def repeats(sizes: DataFrame, shares: list[Share], *, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The documents that are used: ``id_col``, source, tokens, repeats (1 or more, never above the source's cap).

    Every document is used the whole number of times; those whose seeded hash falls into the lowest of ``BUCKETS``
    buckets once more, as many buckets as come nearest to the fractional rest in tokens.
    """
    spark = sizes.sparkSession
    rows = [(s.source, int(s.repeats), (s.repeats - int(s.repeats)) * s.size) for s in shares if s.repeats > 0]
    table = F.broadcast(spark.createDataFrame(rows, "source string, whole int, rest double"))  # MAX_SOURCES rows at most
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BUCKETS)).cast("int")
    listed = sizes.join(table, "source").withColumn("bucket", bucket)
    w = Window.partitionBy("source").orderBy("bucket")  # BUCKETS rows at most
    tried = (
        listed.groupBy("source", "bucket")
        .agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
        .select("source", "bucket", F.abs(F.sum("tokens").over(w) - F.col("rest")).alias("off"))
        .unionByName(table.select("source", F.lit(-1).alias("bucket"), F.col("rest").alias("off")))
    )
    last = tried.groupBy("source").agg(F.min(F.struct("off", "bucket")).getField("bucket").alias("last"))
    return (
        listed.join(F.broadcast(last), "source")  # MAX_SOURCES rows at most
        .withColumn("repeats", F.col("whole") + (F.col("bucket") <= F.col("last")).cast("int"))
        .where(F.col("repeats") > 0)
        .select(id_col, "source", "tokens", "repeats")
    )


def report(used: DataFrame, shares: list[Share]) -> DataFrame:
    """Per listed source: target and actual share of the tokens, size, planned and actual tokens, mean repeats."""
    spark = used.sparkSession
    schema = "source string, target_share double, size_tokens bigint, max_repeats int, planned_tokens double"
    table = spark.createDataFrame([(s.source, s.target, int(s.size), s.cap, s.amount) for s in shares], schema)
    got = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"),
        F.sum("repeats").cast("bigint").alias("documents_used"),
        F.max("repeats").alias("most_repeats"),
    )
    whole = got.agg(F.sum("actual_tokens").alias("all_tokens"))
    return (
        table.join(got, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "size_tokens", "max_repeats", "planned_tokens",
            F.coalesce("actual_tokens", F.lit(0)).cast("bigint").alias("actual_tokens"),
            F.coalesce(F.col("actual_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("documents_used", F.lit(0)).cast("bigint").alias("documents_used"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
