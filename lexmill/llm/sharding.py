"""Sharding by a two-pass external shuffle.

A record's shard is the one of the highest seeded hash of (doc_id, shard number): doc_id and the shard count decide,
and one more shard can only win records for itself. Pass one scatters the records of each shard
uniformly into buckets of about `bucket_bytes` by a second seeded hash; pass two reads one bucket at a time into memory,
puts it into a fixed order and shuffles it (Fisher-Yates, seeded by shard and bucket). A record's slot is
its place in its bucket behind the records of the shard's earlier buckets, whose counts come from pass one's
hashes alone. The outcome depends on the records and the seed only, so a lost task repeats it.

Defined cases: a null text has size 1 and the checksum of no bytes; null doc_ids share a shard. Equal
texts are dealt apart by their doc_ids. Rows equal in doc_id and text meet in one bucket, where
they take slots of their own; only such repeats can make a bucket larger than planned. An empty table gives
no row. Extra columns travel with their records and take part in the fixed order; a caller's columns shard, grown_shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


#: Buckets whose counts, a row of 24 bytes each, are broadcast; beyond them the counts are joined by a shuffle.
FEW_BUCKETS = 200_000


def shard_of(doc_id, shards: int, seed: int):
    """The shard whose hash with doc_id is highest (ties: the lowest number)."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(F.lit(seed), doc_id, F.lit(s)).alias("h"), F.lit(-s).alias("s")) for s in range(shards)))).getField("s") * -1


def shuffle_into_shards(docs: DataFrame, shards: int = 8, *, doc_id="doc_id", text="text", seed=17, bucket_bytes=48 << 20) -> DataFrame:
    """docs with shard (int), grown_shard (int; with one shard more) and slot (long, gapless in its shard)."""
    docs = docs.drop("shard", "grown_shard", "slot", "__lexmill_bucket")
    key, size = F.col(doc_id), F.coalesce(F.octet_length(text), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    rows = docs.withColumns({
        "shard": shard_of(key, shards, seed), "grown_shard": shard_of(key, shards + 1, seed),
        "__lexmill_bucket": F.pmod(F.xxhash64(F.lit(seed + 1), key, F.xxhash64(text)), F.lit(buckets)).cast("int"),
    })
    counts = rows.groupBy("shard", "__lexmill_bucket").agg(F.count(F.lit(1)).alias("__lexmill_n"))
    before = counts.withColumn("__lexmill_before", F.coalesce(F.sum("__lexmill_n").over(W.partitionBy("shard").orderBy("__lexmill_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("__lexmill_n")
    if buckets * shards <= FEW_BUCKETS:
        before = F.broadcast(before)  # one row for each bucket
    schema = T.StructType([*rows.schema.fields, T.StructField("__lexmill_place", T.LongType())])

    def fisher_yates(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        task = pa.Table.from_batches(held)
        number = np.array(task["shard"]) * buckets + np.array(task["__lexmill_bucket"])
        for each in np.unique(number):  # one, unless fewer partitions than buckets are made
            bucket = task.filter(pa.array(number == each))
            by = [(c, "ascending") for c in (doc_id, *(c for c in names if c != doc_id))]
            keys = pa.table({c: _sortable(bucket[c]) for c, _ in by})
            order = np.array(pc.sort_indices(keys, sort_keys=by))
            rng = np.random.Generator(np.random.PCG64([seed, int(each) // buckets, int(each) % buckets]))
            rng.shuffle(order)
            yield from bucket.take(pa.array(order)).append_column("__lexmill_place", pa.array(np.arange(len(order), dtype=np.int64))).to_batches()

    # One partition for each bucket: what a task reads doesn't grow with the input, and no two buckets meet in a task.
    names = docs.columns
    dealt = rows.repartitionById(buckets * shards, F.col("shard") * F.lit(buckets) + F.col("__lexmill_bucket"))
    out = dealt.mapInArrow(fisher_yates, schema)
    return out.join(before, ["shard", "__lexmill_bucket"]).select(*docs.columns, "shard", "grown_shard", (F.col("__lexmill_before") + F.col("__lexmill_place")).alias("slot"))


def _sortable(column):
    """A column as what Arrow can order: itself, or its values as text."""
    import pyarrow as pa

    kind = column.type
    if pa.types.is_boolean(kind):
        return column.cast(pa.int8())
    if pa.types.is_nested(kind) or pa.types.is_binary(kind):
        return pa.chunked_array([pa.array([None if v is None else repr(v) for v in column.to_pylist()], pa.string())])
    return column


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """A folder of Parquet files for each shard, one file for each bucket, in which slots ascend without a gap; no task holds more than a bucket."""
    shuffle_into_shards(docs, shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(sharded: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return sharded.select(doc_id, (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
