"""Sharding: a two-pass external shuffle in DataFrame operations alone.

Pass one scatters the records uniformly into buckets of bounded size by a seeded hash; pass
two gathers each bucket, brings it into a fixed order and Fisher-Yates shuffles it
(``shuffle`` over an array is that algorithm). Bucket after bucket the records form one
random sequence, and record ``p`` of it goes to shard ``p mod shards``: the law ``rows``, counts
at most one apart.

Only (id, size, checksum and what the caller asks for) moves; a bucket's record count is
bounded, so no task gathers more. A record's bucket comes from a hash of its id, its
checksum and its place in the scan, so rows that repeat an id, or have none, spread too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import checkpoint_dir, cut

#: Records that a bucket holds on average, and bytes of them if records carry their texts.
BUCKET_ROWS, BUCKET_BYTES = 8192, 32 << 20


def external_shuffle(records: DataFrame, shards: int = 16, seed: int = 20240501, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, stable: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and a struct ``record`` of the columns in ``carry``.

    size: UTF-8 bytes of the text plus 1; text_crc32: of those bytes; null text counts as
    none. shard is 0 to ``shards - 1``, slot gapless from 0 in each. The same input files and seed give
    the same shuffle. Null ids stay null; equal rows are separate records; columns that
    are not carried are ignored whatever their names (carried ones must be orderable, so no
    maps); an empty table gives no rows. ``stable`` says that the records are a plain scan of files, which gives each
    record the same place whenever it is read: they are then not written down before they move.
    """
    spark = records.sparkSession
    checkpoint_dir(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = records.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
        *([F.struct(*carry).alias("record")] if carry else []),
    )
    slim = slim.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "place"))
    slim = slim if stable else cut(slim)
    total = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total.n // bucket_rows), -(-total.b // bucket_bytes) if carry else 1)
    bucketed = slim.withColumn("bucket", F.pmod("key", F.lit(buckets)))

    # Pass one: how many records each bucket has and how many stand before it.
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    # Pass two: gather, order, shuffle.
    gathered = bucketed.groupBy("bucket").agg(F.collect_list(F.struct("key", "place", "doc_id", "size", "text_crc32", *(["record"] if carry else []))).alias("records"))
    ordered = gathered.select("bucket", F.array_sort("records").alias("records"))
    shuffled = ordered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", seed).alias("records"))
    placed = shuffled.join(before, "bucket").select("before", F.posexplode("records").alias("pos", "r"))
    place = F.col("before") + F.col("pos")
    out = [F.col("r.doc_id"), F.col("r.size"), F.col("r.text_crc32"), F.lit("rows").alias("law"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.select(*out, *([F.col("r.record")] if carry else []))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write carried records as one folder per shard, straight from the shuffled buckets; each file is in slot order."""
    flat = shuffled.select("shard", "slot", "record.*") if "record" in shuffled.columns else shuffled
    flat.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def written_shards(shuffled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of :func:`external_shuffle` after its carried records were written to the shared folder: size and checksum come from the files."""
    spark = shuffled.sparkSession
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(shuffled, path)
    record = shuffled.schema["record"].dataType
    files = spark.read.schema(StructType([StructField("slot", LongType()), *record.fields, StructField("shard", IntegerType())])).parquet(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return files.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
