"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that must stay together; groups go, largest first,
to the shard with the least bytes, which a heap gives. Where one size has as many
groups as there are shards or more, the heap's steps are taken in bulk: the level up to
which they fill the shards is found by bisection, and the shards end where one step for
each group would end. So the driver reads a histogram of group sizes as a stream (k
distinct sizes take at least k * (k + 1) / 2 bytes of text: at most 14 million for
100 TB), writes the plan to a table in pieces of PIECE sizes, and never holds a list of
groups or sizes. Which group of a size goes where follows from its rank among them, by
the hash of its text.

Defined results: the law is `bytes`; a null text counts as an empty one; repeated
rows are rows of one group with slots of their own; a group larger than a fair share
has its shard nearly for itself; equally loaded shards are taken in the order of their
numbers, groups of equal size in that of their texts' hashes; very long texts are
hashed whole, in one row; an empty table gives no rows; columns of the input other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.common import cut, join_salted, n_buckets, remove_at_exit, shared_folder, two_level_offsets, utf8_bytes

SHARDS = 16
#: Groups of one size are ranked in so many parts; sizes of the plan that the driver holds at a time.
SALTS, PIECE = 64, 50_000


def fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard gets, if each goes to the least loaded, of equals to the first."""
    # A shard of load l stands at l, l + size, ... when it gets its groups: the `count` least of all these are taken.
    taken = lambda level: sum(-(-(level - x) // size) for x in loads if x < level)
    low, high = min(loads), max(loads) + size * (count // len(loads) + 2)
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if taken(level) <= count else (low, level)
    given = [max(0, -(-(low - x) // size)) for x in loads]
    rest = count - sum(given)
    for s, x in enumerate(loads):  # those that stand at the level itself
        if rest and x <= low and (low - x) % size == 0:
            given[s] += 1
            rest -= 1
    return given


def schedule(sizes: Iterable[tuple[int, int]], shards: int = SHARDS) -> Iterator[tuple[int, list[int]]]:
    """(size, number of groups) in descending order of size -> (size, number of groups for each shard)."""
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        if count < shards:
            given = [0] * shards
            for _ in range(count):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                given[s] += 1
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            given = fill(loads, size, count)
            heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, given))]
            heapq.heapify(heap)
        yield size, given


def _plan(histogram: DataFrame, shards: int) -> DataFrame:
    """histogram (group_size, n) -> group_size, upto: how many groups of the size lie in each shard or before it."""
    spark = histogram.sparkSession
    path = f"{shared_folder(spark)}/plan-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)

    def write(rows: list[tuple[int, list[int]]]) -> None:
        spark.createDataFrame(rows, "group_size long, upto array<long>").coalesce(1).write.mode("append").parquet(path)

    rows: list[tuple[int, list[int]]] = []
    write(rows)
    for size, given in schedule(((r[0], r[1]) for r in histogram.toLocalIterator(prefetchPartitions=True)), shards):
        total = 0
        rows.append((size, [total := total + g for g in given]))
        if len(rows) == PIECE:
            write(rows)
            rows = []
    if rows:
        write(rows)
    return spark.read.schema("group_size long, upto array<long>").parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (utf8_bytes(text) + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = cut(rows)
    groups = rows.groupBy("key").agg(F.sum("size").alias("group_size"))
    groups = cut(groups.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")))
    plan = _plan(groups.groupBy("group_size").agg(F.count("*").alias("n")).orderBy(F.desc("group_size")), shards)
    # Rank among the groups of one size: those of lower salts, then by key.
    before = two_level_offsets(groups, ["group_size"], "salt", F.lit(1)).join(plan, "group_size")
    within = F.row_number().over(Window.partitionBy("group_size", "salt").orderBy("key")) - 1
    ranked = groups.withColumn("within", within).join(before, ["group_size", "salt"])
    rank = F.col("before") + F.col("within")
    placed = ranked.select("key", F.size(F.filter("upto", lambda end: end <= rank)).alias("shard"))
    joined = join_salted(rows, placed, ["key"])
    parts = n_buckets(rows.count() // shards)
    # Rows that are equal spread too, by their places.
    bucket = F.pmod(F.xxhash64("doc_id", "key", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), F.lit(parts)).cast("int")
    joined = cut(joined.select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")))
    # Slots: those of lower buckets, then by doc_id; one bucket holds some 50,000 rows at any size.
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    slots = joined.withColumn("own", own).join(two_level_offsets(joined, ["shard"], "bucket", F.lit(1)), ["shard", "bucket"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
