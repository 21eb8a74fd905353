"""Near-duplicates by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

A 64-bit fingerprint is split into ``radius + 3`` blocks; two that differ in at most
``radius`` bits agree on at least three of them. So fingerprints are joined on each choice
of three blocks, and pairs verified. A block shared by more than ``BUSY`` distinct
fingerprints is not paired: there, each fingerprint names itself and its one-bit
neighbours as centres. For a radius of 2, two fingerprints link exactly if they share a
centre, and a centre has at most 65 members, so the same links are found without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, fresh, slices, texts
from lamina.llm.components import roots

RADIUS, SHINGLE, BLOCKS, CHOSEN, BUSY = 2, 3, 5, 3, 32


def hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles in turn, A-Z lower-cased; fewer words than ``shingle`` make one, no words none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, 42) for g in grams), "<u8", max(1, len(words) - shingle + 1))


def majority(bits: np.ndarray) -> int:
    """The 64-bit number whose bits are set where over half of the numbers have them set; 0 of none."""
    n, ones = len(bits), np.zeros(64, np.int64)
    for begin in range(0, n, 1 << 16):
        some = np.unpackbits(bits[begin : begin + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        for at in range(0, len(some), 255):  # as many as a byte can count
            ones += np.add.reduce(some[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text: the majority of its shingles' hashes, repeats included; 0 without words."""
    return majority(hashes(raw, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as signed long) and the columns ``keep``: one row a document, without a shuffle."""
    chosen = docs.select("doc_id", *(keep or []), F.col("text").alias("text"))
    others = [f for f in chosen.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            fps = np.fromiter((fingerprint(raw, shingle) for raw in texts(batch)), np.uint64, batch.num_rows)
            arrays = [batch.column(f.name) for f in others] + [pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in others), "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", fp long"
    return chosen.mapInArrow(run, schema)


def _masks() -> list[int]:
    """For each choice of blocks, the bits it covers, as signed 64-bit numbers."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(whole[i] for i in chosen) for chosen in combinations(range(BLOCKS), CHOSEN)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame) -> DataFrame:
    """u, v: links between the distinct fingerprints ``fp``, enough to connect all that differ in at most two bits.

    Among the fingerprints of a busy block a link may be given by way of others: the
    components are the same.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks())])
    blocks = fps.select("fp", F.explode(keys).alias("_")).select("fp", "_.b", "_.k")
    shared = blocks.groupBy("b", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(blocks.join(shared, ["b", "k"]))
    few = members.where(F.col("n") <= BUSY).select("b", "k", F.col("fp").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = few.join(few.withColumnRenamed("u", "v"), ["b", "k"]).where((F.col("u") < F.col("v")) & near).select("u", "v")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    busy = members.where(F.col("n") > BUSY).select("fp").distinct()
    centres = busy.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("c"))
    star = centres.withColumn("v", F.min("fp").over(Window.partitionBy("c"))).where(F.col("v") < F.col("fp"))
    return pairs.union(star.select(F.col("fp").alias("u"), "v")).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """fp, component_id for every distinct fp of ``rows`` (doc_id, fp): the least doc_id among all that it can reach."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = roots(links(fps))
    of = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row a document.

    component_id is the smallest doc_id of the documents that a document can reach over
    links, itself included. Null, empty and wordless texts have fingerprint zero and are
    linked like any other; null ids never are the smallest unless all are null; repeated
    rows stay; other columns are ignored. Equal fingerprints are one class throughout, so
    copies cost no pairs.
    """
    rows = cut(fingerprints(docs))
    named = rows.join(classes(rows), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near-duplicates, the one with the smallest doc_id.

    Of rows with that doc_id one stays: by fingerprint, then by a hash of the text;
    null ids come last.
    """
    hashed = F.xxhash64("text").alias("mark")
    rows = cut(fingerprints(docs, keep=[hashed]))
    named = rows.join(classes(rows), "fp")
    # the least of (id, fp, mark), nulls last: combined before the shuffle, one row a group
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"), F.col("mark"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    kept = named.groupBy(group.alias("g")).agg(F.min_by(F.struct(id_name().alias("name"), "mark"), order).alias("_"))
    return only(docs, kept.select("_.name", "_.mark"))


def id_name() -> Column:
    """doc_id as text, null too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``kept`` (name of the id, mark: XXH64 of the text) has; one of equal ones."""
    key, mark = fresh(docs, "_key", "_mark")
    kept = kept.select(F.col("name").alias(key), F.col("mark").alias(mark)).distinct()
    found = docs.withColumn(key, id_name()).withColumn(mark, F.xxhash64("text")).join(kept, [key, mark], "left_semi")
    return found.dropDuplicates([key, mark]).select(*docs.columns)
