"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its doc_id and text and changes only with them, so
records without an id or with one id spread too. Bytes are summed per slot; the map from
slots to shards is a table of one row a slot whose versions are kept, and rebalancing edits
the latest stored version and stores the next.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, number, scratch

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of text, null: none, plus 1), text_crc32 (null: of nothing), virtual_slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def balanced_map(sizes: list[int], shards: int) -> list[int]:
    """The shard of each slot: slots by falling size (then number), each to the lightest shard so far."""
    load, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + sizes[slot], shard))
    return out


def rebalance(sizes: list[int], old: list[int], shards: int) -> list[int]:
    """An edit of ``old`` for ``shards`` shards that moves few slots.

    Slots leave a shard that no longer exists, and shards above the mean, for the
    lightest shard; of an overfull shard the largest slot that fits goes first. A slot
    moves at most once, and never between two shards that are both below the mean.
    """
    out, mean = list(old), sum(sizes) / shards
    load = [0] * shards
    homeless = []
    for slot, shard in enumerate(old):
        if shard < shards:
            load[shard] += sizes[slot]
        else:
            homeless.append(slot)
    by_size = sorted(range(len(sizes)), key=lambda s: (-sizes[s], s))
    light = [(load[s], s) for s in range(shards)]
    heapq.heapify(light)

    def place(slot: int, must: bool) -> bool:
        while light[0][0] != load[light[0][1]]:  # an entry from before the shard's load changed
            heapq.heappop(light)
        to = light[0][1]
        if not must and (to == out[slot] or load[to] + sizes[slot] > mean):
            return False
        load[to] += sizes[slot]
        out[slot] = to
        heapq.heapreplace(light, (load[to], to))
        return True

    for slot in sorted(homeless, key=lambda s: (-sizes[s], s)):
        place(slot, True)
    for slot in by_size:
        shard = out[slot]
        if old[slot] == shard and sizes[slot] and load[shard] - sizes[slot] >= mean - sizes[slot] / 2 and place(slot, False):
            load[shard] -= sizes[slot]
            heapq.heappush(light, (load[shard], shard))
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int], sizes: list[int]) -> None:
    """Stores a version of the map (slot, shard, bytes) below ``path``; an existing version is never overwritten."""
    rows = [(slot, shard, sizes[slot]) for slot, shard in enumerate(shard_of)]
    table = spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long")
    table.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot, shard, bytes of a stored version."""
    return spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """The versions stored whole below ``path``, ascending, and the number that the next may take."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    whole = [v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS"))]
    return whole, max(found, default=0) + 1


def edit_map(spark: SparkSession, path: str, sizes: list[int], shards: int) -> int:
    """The version below ``path`` to use for ``shards`` shards and slots of ``sizes`` bytes.

    The latest version for at most that many shards (else the latest of all) is loaded,
    edited by ``rebalance``, and stored as the next version if the edit moves a slot. Without a version, the first is made by
    ``balanced_map``. A map for another number of slots is an error. Of two editors at
    once one fails: versions are never overwritten.
    """
    stored, following = versions(spark, path)
    old: list[int] | None = None
    source = 0
    for version in reversed(stored):
        rows = load_map(spark, path, version).collect()  # one row a slot
        if len(rows) != len(sizes):
            raise ValueError(f"version {version} of the map has {len(rows)} slots, not {len(sizes)}")
        found = [0] * len(sizes)
        for r in rows:
            found[r["virtual_slot"]] = r["shard"]
        if old is None or max(found) < shards:
            old, source = found, version
        if max(found) < shards:
            break
    new = balanced_map(sizes, shards) if old is None else rebalance(sizes, old, shards)
    if new == old:
        return source
    save_map(spark, path, following, new, sizes)
    return following


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes in each slot. The driver gets one row a slot, however many records there are."""
    sizes = [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        sizes[r["virtual_slot"]] = r["bytes"]
    return sizes


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard and its place in the shard.

    Returns doc_id, size, text_crc32, law ('bytes': the map makes the shards' bytes near
    equal), shard, slot (the record's place in its shard, gapless from 0), grown_shard
    (null under this law), virtual_slot and rebalanced_shard (its shard after an edit of
    the map for one more shard). Map versions are stored below ``path`` (a scratch folder
    in the shared folder by default): where it has versions, the latest that fits is
    edited instead of a new map made, so a later run on a path moves few slots, and one
    for one more shard takes the edit already stored. Null and repeated ids spread by their
    texts; equal rows share a slot and each keep their row; an empty table gives no rows;
    other columns are ignored.
    """
    if shards < 1 or slots < shards:
        raise ValueError("need at least one shard and as many slots as shards")
    spark = docs.sparkSession
    rows = cut(records(docs, slots))
    sizes = slot_sizes(rows, slots)
    path = path or scratch(spark, "slot-map")
    now = edit_map(spark, path, sizes, shards)
    grown = edit_map(spark, path, sizes, shards + 1)
    later = load_map(spark, path, grown).select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    # one row a slot: the broadcast does not grow with the records
    mapped = rows.join(F.broadcast(load_map(spark, path, now).drop("bytes").join(F.broadcast(later), "virtual_slot")), "virtual_slot")
    placed = number(mapped, ["shard"], "virtual_slot", [F.col(c) for c in ("doc_id", "text_crc32", "size")], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "rebalanced_shard",
    )
