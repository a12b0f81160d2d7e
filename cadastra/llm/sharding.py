"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from (0, 1) for every key, from a digest of both; the record
goes to the shard of the largest ``ln(number) / weight``.  So shares follow the weights,
a shard more draws records only to itself, and one less sends away only its own.  All
expressions are the JVM's; texts are read once and stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Hexadecimal digits of a digest that make a number: 52 bits, which doubles hold.
_DIGITS = 13


def _draw(key: Column, shard: int, weight: float) -> Column:
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, _DIGITS), 16, 10).cast("long").cast("double")
    return F.struct((F.log((drawn + 1) / (16.0**_DIGITS + 1)) / weight).alias("pull"), F.lit(-shard).alias("shard"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a string key; of equal pulls the smaller shard.  A null key
    is an empty one."""
    key = F.coalesce(key, F.lit(""))
    return -F.array_max(F.array(*[_draw(key, j, w) for j, w in enumerate(weights)]))["shard"]


def place(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` per row: where it lies in
    ``len(weights)`` shards, its place there and its shard if ``grown`` were the weights.

    Nulls: a null text is an empty one (size 1, checksum 0); null ids share one key.  Rows
    of one id share a shard; equal rows get slots one after the other.  Within a shard
    slots follow the ids.  Very long texts are never moved, an empty table gives no rows,
    other columns are ignored, whatever their names."""
    key, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.monotonically_increasing_id().alias("row"),
    )
    found = numbered(shared.materialise(rows, "placed"), "shard", ["id", "text_crc32", "row"])
    return found.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows``, a stored table, with ``slot``: 0, 1, ... per ``group`` by ``order``.

    Rows are dealt by ranges of group and order, so a large group lies in many tasks; each
    task counts its own, and the few sums of tasks and groups give every task its start.
    The ranges are stored, so a lost executor cannot change them."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    dealt = shared.materialise(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_task", F.shiftright("_place", 33))
    starts = dealt.groupBy("_task", group).agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_task", group, "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # at most one row a task and group, ranges overlapping by one group: tasks + groups rows
    return dealt.join(F.broadcast(starts), ["_task", group]).withColumn("slot", F.col("_start") + F.col("_place") - F.col("_first")).drop("_task", "_place", "_first", "_start")


def oracle_sql(shards: int = 16) -> str:
    """DuckDB SQL of the query with equal weights; checksums are worked out byte by byte."""
    pull = f"ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j), 1, {_DIGITS}))::BIGINT + 1)::DOUBLE / ({16**_DIGITS} + 1)::DOUBLE)"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    turned = "i"
    for _ in range(8):
        turned = f"list_transform([{turned}], lambda c: {step})[1]"
    return f"""
    WITH polynomial AS (SELECT list_transform(range(256), lambda i: {turned}) AS p),
    pulls AS (SELECT doc_id, text, j, {pull} AS pull FROM documents, range({shards + 1}) r(j)),
    placed AS (SELECT doc_id, any_value(coalesce(text, '')) AS text, arg_max(j, pull) FILTER (j < {shards}) AS shard, arg_max(j, pull) AS grown FROM pulls GROUP BY doc_id)
    SELECT doc_id, strlen(text) + 1 AS size, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown AS INTEGER) AS grown_shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(text), 2 * i - 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, p[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
    FROM placed, polynomial
    """
