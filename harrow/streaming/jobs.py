"""Feed-shaped jobs as Structured Streaming, each sharing its logic with a batch twin.

No source states how late items may come. The delay below is our choice: two
days, twice the longest polling interval.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harrow.functions.keys import stable_key
from harrow.operators.rules import route
from harrow.operators.windows import keep_latest, with_previous
from harrow.session import broadcast_if_small

DELAY = "2 days"


def stream_items(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", per_batch: int = 1000
) -> DataFrame:
    """Landed files as a stream, at most per_batch files a time. Zone-less times become UTC."""
    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)
    ntz = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in ntz}) if ntz else df


def stream_dedupe(df: DataFrame, key: Sequence[str], time: str, delay: str = DELAY) -> DataFrame:
    """The first sight of each key. State is dropped after the delay, so later repeats pass."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def daily_counts(df: DataFrame, time: str, by: str) -> DataFrame:
    """Items per source and UTC day; the same code serves batch and stream."""
    return (
        df.groupBy(F.window(time, "1 day").alias("w"), by)
        .agg(F.count(F.lit(1)).alias("items"))
        .select(F.col("w.start").alias("day"), by, "items")
    )


def stream_daily_counts(df: DataFrame, time: str, by: str, delay: str = DELAY) -> DataFrame:
    return daily_counts(df.withWatermark(time, delay), time, by)


def count_writer(path: str, time: str, by: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step for R-5: the counts of batch n, added up with all others by read_counts.

    Nothing is held in state, so a day has no last call: an item counts however late
    it comes, and days are out as soon as their items are. A replayed batch
    overwrites its own counts.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        daily_counts(batch, time, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def read_counts(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(day, by, items) over all batches written by count_writer."""
    return spark.read.parquet(path).groupBy("day", by).agg(F.sum("items").alias("items"))


# Batches are packed into one folder after this many, so a step lists few folders.
PACK_EVERY = 50

# Bits of the filter in front of the seen keys: 16 MB, sparse for some ten million keys.
SEEN_BITS = 1 << 27
SEEN_BUCKETS = 64


def _bits_of(key: Sequence[str], bits: int) -> Column:
    """The places of a key in the filter, from two hashes, counted from 1."""
    places = [F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(bits)) + 1 for i in range(2)]
    return F.array(*places)


def _bit_is_set(bitmap: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1


def first_sight_writer(
    path: str,
    key: Sequence[str],
    order: Sequence[str],
    bits: int = SEEN_BITS,
    buckets: int = SEEN_BUCKETS,
    pack_every: int = PACK_EVERY,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch step for R-2: the first sight of every key, for good.

    Batch n writes the rows whose key no earlier batch had to first/batch=n, the
    first by `order` of each key. What was seen is those rows themselves, in
    folders by a hash bucket of the key; a bitmap of two bits per key stands in
    front. Keys with a bit missing are new and read nothing; the others are looked up in
    the buckets they fall in. No key is ever forgotten, so a repeat does not pass
    however late it comes. A full bitmap costs look-ups, never a result. A replayed
    batch reads the same earlier folders and overwrites its own.
    """
    key = list(key)

    def written(spark: SparkSession, name: str, schema: T.StructType, n: int) -> DataFrame:
        """What was written before batch n: packed folders, then single ones."""
        packed = n - n % pack_every
        out = spark.createDataFrame([], schema)
        for root, numbers in (
            (f"{path}/{name}-packed", range(pack_every, packed + 1, pack_every)),
            (f"{path}/{name}", range(packed, n)),
        ):
            if numbers:
                reader = spark.read.schema(schema).option("basePath", root)
                part = reader.parquet(*[f"{root}/batch={i}" for i in numbers])
                out = out.unionByName(part.select(*schema.names))
        return out

    def pack(spark: SparkSession, name: str, schema: T.StructType, upto: int) -> DataFrame:
        reader = spark.read.schema(schema).option("basePath", f"{path}/{name}")
        part = reader.parquet(*[f"{path}/{name}/batch={i}" for i in range(upto - pack_every, upto)])
        return part.select(*schema.names)

    bitmap_schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("bitmap", T.BinaryType())])

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r"))
        rows = rows.select("_r.*").withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        rows = rows.persist()  # the batch is read three times; it is small beside what was seen
        fresh = rows
        if batch_id:
            bitmaps = written(spark, "bits", bitmap_schema, batch_id)
            bitmaps = bitmaps.groupBy("slot").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            places = rows.select(*key, F.explode(_bits_of(key, bits)).alias("_p")).select(
                *key, F.bitmap_bucket_number("_p").alias("slot"), F.bitmap_bit_position("_p").alias("_at")
            )
            hit = F.coalesce(_bit_is_set("bitmap", F.col("_at")), F.lit(False))
            maybe = (
                places.join(broadcast_if_small(bitmaps), "slot", "left")
                .groupBy(*key)
                .agg(F.bool_and(hit).alias("_maybe"))
                .filter("_maybe")
                .select(*key, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket"))
            ).persist()
            touched = [r[0] for r in maybe.select("_bucket").distinct().collect()]  # at most `buckets` numbers
            if touched:
                seen = written(spark, "first", rows.schema, batch_id).filter(F.col("_bucket").isin(touched))
                same = [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key]
                known = seen.select(*key).alias("s").join(maybe.alias("m"), same, "left_semi")
                same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
                fresh = rows.alias("r").join(known.alias("k"), same, "left_anti")
            maybe.unpersist()
        # one file a bucket, not one from every task
        fresh.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/first/batch={batch_id}")
        # bits of every key of the batch: those seen before are set already
        marked = rows.select(F.explode(_bits_of(key, bits)).alias("_p"))
        marked.groupBy(F.bitmap_bucket_number("_p").alias("slot")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("bitmap")
        ).write.mode("overwrite").parquet(f"{path}/bits/batch={batch_id}")
        rows.unpersist()
        after = batch_id + 1
        if after % pack_every == 0:
            firsts = pack(spark, "first", rows.schema, after)
            firsts.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/first-packed/batch={after}")
            bitmaps = pack(spark, "bits", bitmap_schema, after)
            bitmaps.groupBy("slot").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).write.mode(
                "overwrite"
            ).parquet(f"{path}/bits-packed/batch={after}")

    return step


def versions(items: DataFrame, known: DataFrame | None, key: str, time: str, fields: Sequence[str]) -> DataFrame:
    """Every distinct version (key, time, content_hash) and its change, in event-time order.

    new, modified or unchanged against the version before it, which may be the
    known one (key, time, content_hash); stale when it is older than the known one.
    Versions of one time are ordered by their hash. The batch twin of stream_versions.
    """
    found = items.select(key, time, stable_key(*fields).alias("content_hash")).distinct()
    if known is not None:
        known = known.select(
            F.col(key).alias("_k"), F.col(time).alias("_kt"), F.col("content_hash").alias("_kh")
        )
        found = found.join(known, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    else:
        found = found.withColumns({"_kt": F.lit(None).cast("timestamp"), "_kh": F.lit(None).cast("string")})
    late = F.coalesce(F.col(time) < F.col("_kt"), F.lit(False))
    behind = found.filter(late).withColumn("change", F.lit("stale"))
    seen = with_previous(found.filter(~late), key, [time, "content_hash"], ["content_hash"])
    before = F.coalesce("prev.content_hash", "_kh")
    change = (
        F.when(before.isNull(), "new").when(before == F.col("content_hash"), "unchanged").otherwise("modified")
    )
    columns = [key, time, "content_hash", "change"]
    return seen.withColumn("change", change).select(*columns).unionByName(behind.select(*columns))


def _classified(times: list, hashes: list, at: int, known: tuple | None) -> str:
    """The change of version number `at`, as versions says."""
    if known and times[at] < known[0]:
        return "stale"
    before = known[1] if known else None
    if at and not (known and times[at - 1] < known[0]):
        before = hashes[at - 1]
    return "new" if before is None else "unchanged" if before == hashes[at] else "modified"


# Keys of one of so many hash buckets share a state in stream_versions.
VERSION_BUCKETS = 1 << 13


def stream_versions(
    items: DataFrame,
    key: str,
    time: str,
    fields: Sequence[str],
    known: DataFrame | None = None,
    buckets: int = VERSION_BUCKETS,
) -> DataFrame:
    """The changes of a stream of items, in update mode: (key, time, content_hash, change).

    State holds the versions of each key in event-time order, the keys of one hash bucket
    together: a bucket costs far more to open than a key. An item that comes
    late takes its place among them, and the version after it is given out again
    with its changed meaning; the newest row of a version counts (read_versions). So
    the result equals versions over all items, however they fall into files and
    batches. known is a stream of (key, time, content_hash), the versions held before;
    it is read once into state. A NULL time or key is dropped: it has no place.
    A checkpoint goes on with the number of buckets it began with only.
    """
    keyed = items.select(
        F.col(key).alias("key"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
        stable_key(*fields).alias("content_hash"),
        F.lit(False).alias("known"),
    )
    if known is not None:
        old = known.select(
            F.col(key).alias("key"),
            F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
            "content_hash",
            F.lit(True).alias("known"),
        )
        keyed = keyed.unionByName(old)
    keyed = keyed.filter("key IS NOT NULL AND micros IS NOT NULL")
    key_type = keyed.schema["key"].dataType

    def merge(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else ([], [], [], [], [])
        held = {k: list(zip(t, h, strict=True)) for k, t, h in zip(*kept[:3], strict=True)}
        old = {k: (t, h) for k, t, h in zip(kept[0], *kept[3:], strict=True) if h is not None}
        touched, all_again = {}, set()
        for batch in batches:
            for k, micros, content, is_known in zip(
                *(batch[c].tolist() for c in ("key", "micros", "content_hash", "known")), strict=True
            ):
                version = (micros, content)
                own = held.setdefault(k, [])
                if is_known:
                    if k not in old or version > old[k]:
                        old[k] = version
                        all_again.add(k)
                    continue
                place = bisect_left(own, version)
                if place == len(own) or own[place] != version:
                    own.insert(place, version)
                    touched.setdefault(k, set()).add(version)
        times, hashes = ({k: [v[i] for v in own] for k, own in held.items()} for i in (0, 1))
        olds = [old.get(k, (None, None)) for k in held]
        state.update(
            (list(held), list(times.values()), list(hashes.values()), [t for t, _ in olds], [h for _, h in olds])
        )
        made = []
        for k in touched.keys() | all_again:
            own = held[k]
            places = set(range(len(own))) if k in all_again else set()
            for version in touched.get(k, ()):
                place = bisect_left(own, version)
                places |= {place, min(place + 1, len(own) - 1)}
            made += [(k, *own[i], _classified(times[k], hashes[k], i, old.get(k))) for i in sorted(places)]
        if made:
            yield pd.DataFrame(made, columns=["key", "micros", "content_hash", "change"])

    out = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("micros", T.LongType()),
            T.StructField("content_hash", T.StringType()),
            T.StructField("change", T.StringType()),
        ]
    )
    held = T.StructType(
        [
            T.StructField("keys", T.ArrayType(key_type)),
            T.StructField("times", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("hashes", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("known_times", T.ArrayType(T.LongType())),
            T.StructField("known_hashes", T.ArrayType(T.StringType())),
        ]
    )
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInPandasWithState(merge, out, held, "update", "NoTimeout")
    return found.select(
        F.col("key").alias(key), F.timestamp_micros("micros").alias(time), "content_hash", "change"
    )


def version_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step for R-3: the versions a batch made or changed, one folder per batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def read_versions(spark: SparkSession, path: str, key: str, time: str) -> DataFrame:
    """Each version with its last given change."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key, time, "content_hash").agg(F.max_by("change", "batch").alias("change"))


def classify_changes(
    items: DataFrame, known: DataFrame, key: str, time: str, fields: Sequence[str]
) -> DataFrame:
    """The newest item per key marked new, modified, unchanged or stale against the known versions.

    known holds (key, content_hash, time) of the latest version of every key. An
    item older than the known version is stale: it comes late and changes nothing.
    """
    hashed = items.withColumn("content_hash", stable_key(*fields))
    latest = keep_latest(hashed, key, [time], "content_hash")
    old = known.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"), F.col(time).alias("_t"))
    change = (
        F.when(F.col("_k").isNull(), "new")
        .when(F.col(time) < F.col("_t"), "stale")
        .when(F.col("_h") == F.col("content_hash"), "unchanged")
        .otherwise("modified")
    )
    return (
        latest.join(old, F.col(key) == F.col("_k"), "left")
        .withColumn("change", change)
        .drop("_k", "_h", "_t")
    )


def change_writer(
    path: str, key: str, time: str, fields: Sequence[str], compact_every: int = 50
) -> Callable[[DataFrame, int], None]:
    """foreachBatch step for change detection.

    Batch n writes its changes to changes/batch=n. What is known before it is
    the last snapshot written earlier plus the changes since; every
    compact_every batches a snapshot of all latest versions is added, so a
    batch reads a bounded number of folders. A replayed batch reads the same
    earlier folders and overwrites its own, so a replay changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = T.StructType(
            [batch.schema[key], T.StructField("content_hash", T.StringType()), batch.schema[time]]
        )

        def known_before(n: int) -> DataFrame:
            base = n - n % compact_every
            folders = [f"{path}/changes/batch={i}" for i in range(base, n)]
            if base:
                folders.append(f"{path}/snapshots/before={base}")
            if not folders:
                return spark.createDataFrame([], state)
            versions = spark.read.schema(state).parquet(*folders)
            return keep_latest(versions, key, [time], "content_hash")

        known = known_before(batch_id).select(key, "content_hash", time)
        out = classify_changes(batch, known, key, time, fields)
        out.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        after = batch_id + 1
        if after % compact_every == 0:
            first = after - compact_every
            folders = [f"{path}/changes/batch={i}" for i in range(first, after)]
            if first:
                folders.append(f"{path}/snapshots/before={first}")
            versions = spark.read.schema(state).parquet(*folders)
            latest = keep_latest(versions, key, [time], "content_hash")
            latest.write.mode("overwrite").parquet(f"{path}/snapshots/before={after}")

    return step


def route_writer(
    routed_path: str, rules: Sequence, priority: F.Column | None = None
) -> Callable[[DataFrame, int], None]:
    """foreachBatch step for R-4: routed rows, one folder per batch and destination."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch if priority is None else batch.withColumn("priority", priority)
        (
            route(rows, rules)
            .write.mode("overwrite")
            .partitionBy("destination")
            .parquet(f"{routed_path}/batch={batch_id}")
        )

    return step


def run_to_files(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process all landed input into Parquet files, then stop."""
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query


def run_each_batch(
    df: DataFrame, step: Callable, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process all landed input through a foreachBatch step, then stop."""
    query = (
        df.writeStream.foreachBatch(step)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
