"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight times one common level, clamped at ``max_epochs``
times its size; clamping hands the excess to the others by weight. A target becomes whole
repetitions of the source and one fractional repetition: a seeded order of its documents
up to the remaining words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import WORD, cut, word_count

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hexadecimal digits of the key that make a bin, and bytes of sources' boundaries that are broadcast.
BIN, BROADCAST = 3, 32 << 20


def water_fill(sources: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """Adds ``target`` to one row a source (columns src, source_size).

    Sources by code point, null last, take ``weights`` in turn. In order of
    cap / weight, a source is clamped if it cannot hold the level left by those clamped
    before it; the level of the first that can is final. This is what resharing the
    excess until none is above its cap ends with, without the rounds. One task sorts the
    sources (not their rows), spilling if need be.
    """
    every, by_name = Window.partitionBy(), Window.orderBy("src")
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", w.cast("long"))
    t = t.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = F.sum("source_size").over(every).cast("double") * F.lit(float(budget))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0)).cast("double")
    free = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    t = t.withColumn("_level", left / free.cast("double"))
    t = t.withColumn("_clamped", F.col("_ratio") <= F.col("_level"))
    level = F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(every)
    return t.select("src", "source_size", F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level).alias("target"))


def _named(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, src, size, _key, _bin: a document's source, words, and place in the seeded order."""
    key, src = _order(seed)
    rows = docs.select("doc_id", src.alias("src"), word_count(F.col("text")).alias("size"), key.alias("_key"))
    return rows.withColumn("_bin", F.substring("_key", 1, BIN))


def _order(seed: str) -> tuple[Column, Column]:
    """A document's key in the seeded order, and its source with null after all others."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return key, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(">"))


def _offsets(rows: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """src, _bin, _before, _size, source_size, target, _copies, _rest: one row a source and bin, with the words in earlier bins."""
    if not weights or min(weights) < 1 or budget < 0 or max_epochs < 1:
        raise ValueError("weights must be positive, the budget not negative and max_epochs at least 1")
    bins = rows.groupBy("src", "_bin").agg(F.sum("size").alias("_size"))
    targets = water_fill(bins.groupBy("src").agg(F.sum("_size").alias("source_size")), weights, budget, max_epochs)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - (F.col("_copies") * F.col("source_size")).cast("double")).cast("long")
    ahead = Window.partitionBy("src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(ahead), F.lit(0))
    return bins.withColumn("_before", before).join(targets.withColumn("_copies", copies).withColumn("_rest", rest), "src")


def takes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, part_words: one row a document.

    size counts words (null text: 0); copies is the whole repetitions that every document
    of the source gets; part_words is what the fractional repetition takes of this one:
    all its words up to the boundary in the seeded order, some at the boundary, none
    beyond. taken = size * copies + part_words, so a source's taken words are its target
    rounded to a word. The order hashes the seed and doc_id; repeated ids follow by size.
    Null is a source of its own; an empty table gives no rows; other columns are ignored.

    Rows are binned by the hash, so sums and order never need a source in one task.
    """
    rows = cut(_named(docs, seed))
    offsets = _offsets(rows, weights, budget, max_epochs).drop("_size")
    within = Window.partitionBy("src", "_bin").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    out = rows.join(offsets, ["src", "_bin"]).withColumn("_start", start).withColumn("part_words", _part())
    taken = F.col("size") * F.col("_copies") + F.col("part_words")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("_copies").alias("copies"), "part_words")


def _part() -> Column:
    """What the fractional repetition takes of a document that begins at the word ``_start``."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_start")))


def boundaries(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """src, target, _copies, _edge, _last: where each source's fractional repetition ends.

    Documents of bins before ``_edge`` are in it, and those of that bin up to ``_last``
    (key, doc_id, size; n: how many equal to it are taken; of: how many there are).
    Only the rows of one bin a source are put in order.
    """
    over = F.min(F.when(F.col("_before") + F.col("_size") > F.col("_rest"), F.struct("_bin", "_before"))).alias("_at")
    ends = offsets.groupBy("src", "target", "_copies", "_rest").agg(over)
    ends = cut(ends.select("src", "target", "_copies", "_rest", F.col("_at._bin").alias("_edge"), F.col("_at._before").alias("_before")))
    inside = rows.join(_bounded(ends.select("src", "_rest", F.col("_edge").alias("_bin"), "_before"), "src"), ["src", "_bin"])
    within = Window.partitionBy("src").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = inside.withColumn("_start", start).withColumn("_part", _part())
    whole = (F.col("_part") > 0) & (F.col("_part") * 2 >= F.col("size"))
    same = part.groupBy("src", "_key", "doc_id", "size").agg(F.count_if(whole).alias("n"), F.count("*").alias("of")).where("n > 0")
    last = same.groupBy("src").agg(F.max(F.struct("_key", "doc_id", "size", "n", "of")).alias("_last"))
    return cut(ends.join(last, "src", "left").select("src", "target", "_copies", "_edge", "_last"))


def _bounded(table: DataFrame, *strings: str) -> DataFrame:
    """``table`` to be broadcast if its rows are few and its ``strings`` short, else as it is: the join then shuffles."""
    bytes_ = F.sum(sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in strings), F.lit(200)))
    return F.broadcast(table) if (table.agg(bytes_).first()[0] or 0) <= BROADCAST else table


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, all columns, each as often as the mix takes it.

    Whole documents only: the fractional repetition takes the boundary document if half
    of its words or more fall to it. A document without words is kept once if any of its
    source is taken (it weighs nothing). Null is a source of its own; an empty table gives
    no rows; of rows with one id and size at the boundary, some are taken by their text.

    Texts are read twice and not shuffled: the sources' boundaries are broadcast, after a
    check of their size, and each row is compared with that of its source.
    """
    rows = cut(_named(docs, seed))
    ends = boundaries(rows, _offsets(rows, weights, budget, max_epochs))
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    key, src = _order(seed)
    held = docs.select("doc_id", "text", src.alias("src"), key.alias("_key"), F.struct(*own).alias("_row"))
    held = held.join(_bounded(ends, "src", "_last.doc_id"), "src")
    at = F.substring("_key", 1, BIN)
    # the words are counted only where the key is the boundary's
    place = F.when(F.col("_key") != F.col("_last._key"), F.col("_key") < F.col("_last._key")).otherwise(
        F.struct("doc_id", word_count(F.col("text")).alias("size")) <= F.struct("_last.doc_id", "_last.size")
    )
    inside = F.col("_edge").isNull() | (at < F.col("_edge")) | ((at == F.col("_edge")) & F.col("_last").isNotNull() & place)
    tied = (F.col("_key") == F.col("_last._key")) & F.col("doc_id").eqNullSafe(F.col("_last.doc_id")) & (word_count(F.col("text")) == F.col("_last.size"))
    split = F.coalesce(F.col("_last.n") < F.col("_last.of"), F.lit(False))
    wordless = (F.col("target") > 0) & ~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    times = F.when(wordless, F.lit(1).cast("long")).otherwise(F.col("_copies") + inside.cast("long"))
    many = held.withColumn("_split", split & tied).withColumn("_times", times)
    if ends.where(split).limit(1).count():
        nth = F.row_number().over(Window.partitionBy("src").orderBy("text"))
        some = many.where("_split").withColumn("_times", F.col("_copies") + (nth <= F.col("_last.n")).cast("long"))
        many = many.where("not _split").unionByName(some)
    many = many.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return many.select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(docs.columns)])
