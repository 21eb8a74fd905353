"""Near-duplicates by similarity: operator 5 for a radius that pigeonhole blocks cannot serve.

At a similarity (Jaccard, of the sets of five-word shingles) of 0.8 fingerprints differ in
15 % of their bits. A split of 64 bits that must leave one block equal then has blocks of
about 6 bits, which unrelated texts share by chance. So here a text has a wide
fingerprint, of 1024 bits, that tells similarities apart, and blocks of their own make:
block t holds the shingles that are least under the t-th hash. Short texts also name the
shingles of their prefix, one of which two similar ones share for certain. Blocks are joined,
pairs far apart by the wide fingerprints dropped, and the others verified by the exact
similarity of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, slices, slim, texts
from lamina.llm.components import roots, stars
from lamina.llm.simhash import hashes, id_name, majority, only

SHINGLE, SIMILARITY, WIDTH, TABLES, SAMPLE = 5, 0.8, 16, 16, 5
BUSY, AHEAD, CHUNK, SLACK = 16, 4, 256, 2.0
#: Standard deviations that the filter before the exact verification allows; sets up to which it is not asked.
FILTER, SMALL = 4.0, 32
#: Pivots a busy block, and shingles that a piece of those still apart holds (about 8 MB).
PIVOTS, PIECE = 4, 1 << 20
_ODD = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, TABLES + 2 * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MANY = 1 << 16


def radius(similarity: float = SIMILARITY, bits: int = 64 * WIDTH, slack: float = SLACK) -> int:
    """The Hamming distance up to which texts count as similar.

    Sets of one size with a Jaccard similarity s have the cosine 2s / (1 + s), and their
    fingerprints differ in angle / pi of the bits; ``slack`` standard deviations are added,
    so that few pairs at the very threshold are missed (some a little below it are taken).
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def sketch(raw: bytes, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[bytes, np.ndarray, np.ndarray, int, np.ndarray]:
    """(16 bytes that name the set of shingles, its wide fingerprint, its blocks, its size, its prefix) of a text.

    The prefix of a set of n is its n - ceil(similarity n) + 1 least hashes: similar sets have
    one in common in their prefixes. Sets that can be similar to one of ``SMALL`` have it.
    """
    h = np.unique(hashes(raw, shingle))
    wide = np.zeros(WIDTH, np.uint64)
    for j in range(WIDTH):
        x = h * _ODD[TABLES + 2 * j]
        x ^= x >> np.uint64(32)
        x *= _ODD[TABLES + 2 * j + 1]
        x ^= x >> np.uint64(29)
        wide[j] = majority(x)
    least = np.zeros((TABLES, 0), np.uint64)
    for at in range(0, len(h), _MANY):
        some = np.concatenate([least, h[at : at + _MANY] * _ODD[:TABLES, None]], axis=1)
        least = np.partition(some, SAMPLE - 1, axis=1)[:, :SAMPLE] if some.shape[1] > SAMPLE else some
    least.sort(axis=1)
    blocks = np.fromiter((xxhash.xxh64_intdigest(row.tobytes()) for row in least), np.uint64, TABLES)
    most = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if 0 < len(h) <= SMALL / similarity else 0
    return xxhash.xxh3_128_digest(h.tobytes()), wide, blocks, len(h), h[:most]


_WIDE, _BLOCKS = [f"w{j}" for j in range(WIDTH)], [f"b{t}" for t in range(TABLES)]


def sketches(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, mark (XXH64 of the text), s0 and s1 (the set's name), the wide fingerprint, the blocks, size and prefix: one row a document."""
    chosen = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    longs = ["s0", "s1", *_WIDE, *_BLOCKS, "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            table, prefixes = np.zeros((batch.num_rows, len(longs)), np.uint64), []
            for i, raw in enumerate(texts(batch)):
                name, wide, blocks, n, prefix = sketch(raw, shingle, similarity)
                table[i] = np.concatenate([np.frombuffer(name, "<u8"), wide, blocks, np.array([n], np.uint64)])
                prefixes.append(prefix.view(np.int64))
            columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in table.T] + [pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], ["doc_id", "mark", *longs, "prefix"])

    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {id_type}, mark long, " + ", ".join(f"{c} long" for c in longs) + ", prefix array<long>")


def _distance(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:])), F.bit_count(a[0].bitwiseXOR(b[0])))


def _close(a: str, b: str, similarity: float) -> Column:
    """Whether the sketches in the columns with the prefixes ``a`` and ``b`` may be of similar sets: of sizes that allow it, and near or small."""
    near = _distance([F.col(a + c) for c in _WIDE], [F.col(b + c) for c in _WIDE]) <= radius(similarity, slack=FILTER)
    sizes = (F.col(a + "size"), F.col(b + "size"))
    return (F.least(*sizes) >= F.greatest(*sizes) * similarity - 1e-6) & (near | (F.least(*sizes) <= SMALL))


def _sketched(rows: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """``rows`` with the sketch of the node in the column ``side``, in columns of that prefix."""
    return rows.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(side + c) for c in (*_WIDE, "size")]), side)


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, hashes: the set of shingles of each of ``nodes`` (node, least)."""
    wanted = nodes.select("node", F.coalesce(F.col("least.doc_id").cast("string"), F.lit("null")).alias("name"), F.col("least.mark").alias("mark"))
    chosen = docs.select(id_name().alias("name"), F.xxhash64("text").alias("mark"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            found = [np.unique(hashes(raw, shingle)).view(np.int64) for raw in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    rows = chosen.join(wanted.hint("shuffle_merge"), ["name", "mark"]).select("node", "text")
    return rows.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose sets are similar, exactly."""
    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(side + "h")), side)
    both = F.size(F.array_intersect("uh", "vh"))
    return pairs.withColumn("both", both).where(F.col("both") / (F.size("uh") + F.size("vh") - F.col("both")) >= similarity).select("u", "v")


def _apart(rows: DataFrame, linked: DataFrame, side: str, out: str) -> DataFrame:
    """``rows`` with the group ``out`` of the node in the column ``side``."""
    return rows.join(linked.select(F.col("node").alias(side), F.col("root").alias(out)), side, "left").withColumn(out, F.coalesce(out, side))


def _open(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The members of blocks that are not in one group yet: b, k, node, size, group and the block's largest group (main)."""
    named = _apart(members.select("b", "k", "node", "size"), linked, "node", "group")
    sizes = named.groupBy("b", "k", "group").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("b", "k").agg(F.max(F.struct("c", "group")).alias("_"), F.count("*").alias("groups")).where("groups > 1")
    return named.join(largest.select("b", "k", F.col("_.group").alias("main")).hint("rebalance"), ["b", "k"])


def _spanning(a: pa.Table, b: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the groups of ``a`` with those of ``b`` (node, group, hashes) as far as sets are similar: each joins two groups not joined before."""
    values = [t.column("hashes").combine_chunks() for t in (a, b)]
    ends = [np.cumsum([0, *map(len, v)]) for v in values]
    ids = np.unique(np.concatenate([v.flatten().to_numpy() for v in values]), return_inverse=True)[1]
    mine, theirs = ids[: ends[0][-1]], ids[ends[0][-1] :]
    groups = [t.column("group").to_numpy().copy() for t in (a, b)]
    nodes, size, out = [t.column("node").to_numpy() for t in (a, b)], np.diff(ends[1]), []
    there = np.zeros(len(ids), bool)
    for i, n in enumerate(np.diff(ends[0])):
        wanted = (groups[1] != groups[0][i]) & (np.minimum(size, n) >= similarity * np.maximum(size, n) - 1e-6)
        if not wanted.any():
            continue
        own = mine[ends[0][i] : ends[0][i + 1]]
        there[own] = True
        both = np.add.reduceat(there[theirs], ends[1][:-1], dtype=np.int64)
        there[own] = False
        for j in np.flatnonzero(wanted & (both / (n + size - both) >= similarity)):
            old, new = groups[1][j], groups[0][i]
            if old != new:
                out.append((int(nodes[0][i]), int(nodes[1][j])))
                for g in groups:
                    g[g == old] = new
    return out


def _rest(members: DataFrame, sets: DataFrame, linked: DataFrame, similarity: float, n: int) -> DataFrame:
    """u, v: verified links between members of a block that lie in different groups, enough to connect all similar ones.

    ``n`` bounds the rows of ``members``. Of two such members one at least is outside the block's largest group. Blocks with the
    same largest group are taken together, so that a member is there once: those outside
    the group are compared with all members, in pieces of bounded size. A pair of pieces
    gives a link only where it joins two groups, so never more than it has members.
    """
    left = slim(cut(slim(_open(members, linked), n).select("main", "node", "size", "group").distinct()), n)
    outside = F.when(F.col("group") != F.col("main"), F.col("size")).otherwise(0)
    left = left.join(left.groupBy("main").agg(F.sum("size").alias("n"), F.sum(outside).alias("out")).hint("rebalance"), "main")
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / PIECE)).cast("int")
    count = lambda c: F.explode(F.sequence(F.lit(0), pieces(c) - 1))
    at = lambda c: F.pmod(F.xxhash64("node"), pieces(c)).cast("int")
    a = left.where("group != main").select("main", "node", "group", at("out").alias("i"), count("n").alias("j"))
    b = left.select("main", "node", "group", at("n").alias("j"), count("out").alias("i"))
    key = ["main", "i", "j"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _spanning(a, b, similarity) if a.num_rows and b.num_rows else []
        return pa.table({"u": pa.array([min(p) for p in found], pa.int64()), "v": pa.array([max(p) for p in found], pa.int64())})

    # toDF: columns of their own for each side, which are cut from the same tables
    sides = [t.join(sets, "node").select(*key, "node", "group", "hashes").toDF(*key, "node", "group", "hashes").groupBy(*key) for t in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "u long, v long").distinct()


def links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """u, v: links between the rows of ``nodes`` (node, least, sketch), enough to connect all similar ones that share a block.

    Every pair of a block ends in one group or is verified. Blocks of at most ``BUSY`` members
    are paired. Members of a busier block, where texts are copies with changes of one
    another, are cut at random into pieces of about ``CHUNK``, sorted by two words of the
    wide fingerprint that change with the block's number, and compared with the next
    ``AHEAD``. That links most, and tells which members have most near ones: those, the
    originals of copies, are compared with all of the block. What then is in different
    groups of a block is compared pair by pair, and links come of it where they join groups.
    """
    keys = F.concat(
        F.array(*[F.struct(F.lit(t).alias("b"), F.col(c).alias("k")) for t, c in enumerate(_BLOCKS)]),
        F.transform("prefix", lambda k: F.struct(F.lit(TABLES).alias("b"), k.alias("k"))),
    )
    blocks = nodes.select("node", "size", F.explode(keys).alias("_")).select("node", "size", "_.b", "_.k")
    shared = blocks.groupBy("b", "k").agg(F.count("*").alias("n")).where("n > 1").hint("rebalance")
    members = cut(blocks.join(shared, ["b", "k"]))
    n = members.count()
    members = slim(members, n)
    few = members.where(F.col("n") <= BUSY).select("b", "k", F.col("node").alias("u"))
    pairs = few.join(few.withColumnRenamed("u", "v"), ["b", "k"]).where(F.col("u") < F.col("v")).select("u", "v")
    pairs = slim(slim(pairs, BUSY * n).distinct(), BUSY * n)
    apart = _distance([F.col("u" + c) for c in _WIDE], [F.col("v" + c) for c in _WIDE]).alias("d")
    near = _sketched(_sketched(pairs, nodes, "u"), nodes, "v").where(_close("u", "v", similarity)).select("u", "v", apart)

    crowd = members.where(F.col("n") > BUSY)
    busy = _sketched(crowd.drop("size").withColumnRenamed("node", "u"), nodes, "u")
    words = F.array(*["u" + c for c in _WIDE])
    busy = busy.withColumn("piece", F.pmod(F.xxhash64("u", "b"), F.ceil(F.col("n") / CHUNK)))
    for i, step in enumerate((0, 3)):
        busy = busy.withColumn(f"o{i}", F.element_at(words, F.pmod(F.col("b") + step, F.lit(WIDTH)).cast("int") + 1))
    after = Window.partitionBy("b", "k", "piece").orderBy("o0", "o1", "u")
    own = ["u", *["u" + c for c in (*_WIDE, "size")]]
    ahead = [F.struct(*[F.lead(c, i).over(after).alias("v" + c[1:]) for c in own]) for i in range(1, AHEAD + 1)]
    seen = busy.select(*own, F.array(*ahead).alias("next")).select(*own, F.explode("next").alias("_")).select(*own, "_.*").where("v is not null")
    star = seen.where(_close("u", "v", similarity)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), apart)
    likely = cut(near.union(star).distinct())
    m = likely.count()
    likely = slim(likely, m)

    sets = cut(_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), shingle))
    # the nearest of each node first: most others are then in its group and need no sets
    first = likely.groupBy("u").agg(F.min_by("v", "d").alias("v")).union(likely.groupBy("v").agg(F.min_by("u", "d").alias("u")).select("u", "v"))
    first = slim(slim(first, m).distinct(), m)
    linked = roots(_verified(first, sets, similarity))

    rest = _apart(_apart(likely.select("u", "v"), linked, "u", "ug"), linked, "v", "vg").where("ug != vg").select("u", "v")
    both = likely.select("u", "d").union(likely.select(F.col("v").alias("u"), "d"))
    score = slim(both.groupBy(F.col("u").alias("node")).agg(F.sum(F.lit(64 * WIDTH) - F.col("d")).alias("score")), m)
    left = slim(cut(slim(_open(crowd, linked), n)), n)
    best = F.max_by(F.struct("node", "group"), F.struct(F.coalesce("score", F.lit(0)), "node")).alias("_")
    pivots = left.join(score, "node", "left").groupBy("b", "k", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(best).select("b", "k", F.col("_.node").alias("p"), F.col("_.group").alias("pg"))
    pivots = slim(pivots, n).hint("rebalance")
    tried = left.join(pivots, ["b", "k"]).where("group != pg").select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v"))
    tried = slim(slim(tried, PIVOTS * n).distinct(), PIVOTS * n)
    tried = _sketched(_sketched(tried, nodes, "u"), nodes, "v").where(_close("u", "v", similarity)).select("u", "v")
    linked = roots(stars(linked).union(_verified(rest.union(tried).distinct(), sets, similarity)))
    return stars(linked).union(_rest(crowd, sets, linked, similarity, n))


def groups(docs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """root, s0, s1, least: for each distinct set of shingles of ``rows``, the sketches of ``docs``, its group and its least (no id, id, mark)."""
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    sets = rows.groupBy("s0", "s1").agg(order, *[F.first(c).alias(c) for c in (*_WIDE, *_BLOCKS, "size", "prefix")])
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    linked = roots(links(nodes, docs, similarity, shingle))
    found = nodes.select("node", "s0", "s1", "least").join(linked, "node", "left")
    return found.select(F.coalesce("root", "node").alias("root"), "s0", "s1", "least")


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id: one row a document; component_id is the smallest doc_id of its group.

    Groups are linked by similarity, also by way of others. Texts without words (null,
    empty) are one group; equal sets of shingles always are. Null ids are the smallest
    only if all are; repeated rows stay; other columns are ignored.
    """
    rows = cut(sketches(docs, shingle, similarity))
    sets = groups(docs, rows, similarity, shingle)
    first = sets.groupBy("root").agg(F.min("least").alias("_"))
    named = sets.join(first, "root").select("s0", "s1", F.col("_.doc_id").alias("component_id"))
    return rows.select("doc_id", "s0", "s1").join(named, ["s0", "s1"]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of similar texts, the one with the smallest doc_id.

    Of several rows with that id one stays, by a hash of the text; null ids come last.
    """
    sets = groups(docs, cut(sketches(docs, shingle, similarity)), similarity, shingle)
    first = sets.groupBy("root").agg(F.min("least").alias("_")).select("_.doc_id", "_.mark")
    return only(docs, first.select(id_name().alias("name"), "mark"))
