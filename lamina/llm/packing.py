"""Packing into optimal length buckets.

A global histogram of sequence lengths (at most ``max_length`` rows) goes to the
driver; a dynamic program chooses the ``buckets`` upper bounds that minimise padding;
inside each bucket, sequences form batches that fill a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, fresh, number, word_count

MAX_LENGTH, BUCKETS, TOKEN_BUDGET = 2048, 16, 65_536


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds (ascending; the last is the greatest length) of at most ``buckets`` buckets with least padding.

    ``best[j]`` is the least padding of the first j lengths in k buckets; a bucket over
    lengths i..j-1 pads each of its rows up to length j-1. Ties take the smaller i.
    No lengths give no bounds. The best i never falls as j grows, so each j looks between
    those of its neighbours only: buckets x lengths x log(lengths) steps.
    """
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(size):
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    best = np.concatenate([[0], size * rows[1:] - tokens[1:]]).astype(np.int64)
    cuts = []
    for _ in range(1, min(buckets, len(size))):
        new, at = best.copy(), np.zeros(len(size) + 1, np.int64)
        spans = [(1, len(size), 0, len(size) - 1)]
        while spans:
            first, last, low, high = spans.pop()
            if first > last:
                continue
            j = (first + last) // 2
            i = slice(low, min(j - 1, high) + 1)
            cost = best[i] + size[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            at[j] = low + int(np.argmin(cost))
            new[j] = cost[at[j] - low]
            spans += [(first, j - 1, low, at[j]), (j + 1, last, at[j], high)]
        best = new
        cuts.append(at)
    bounds, j = [int(size[-1])], len(size)
    for at in reversed(cuts):
        j = int(at[j])
        if j == 0:
            break
        bounds.append(int(size[j - 1]))
    return bounds[::-1]


def sequences(docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, chunk, start, length: each document as sequences of at most ``max_length`` tokens.

    ``length`` counts a document's tokens; by default its words and one end token, so a
    null or empty text is one sequence of length 1. No token is dropped: a long document
    gives several sequences.
    """
    (n,) = fresh(docs, "_tokens")
    tokens = word_count(F.col("text")) + 1 if length is None else F.coalesce(length.cast("long"), F.lit(0))
    split = docs.select("doc_id", F.greatest(tokens, F.lit(1)).alias(n)).select(
        "doc_id", n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / max_length))).alias("chunk")
    )
    start = F.col("chunk") * max_length
    return split.select("doc_id", "chunk", start.alias("start"), F.least(F.lit(max_length), F.col(n) - start).cast("long").alias("length"))


def pack(
    docs: DataFrame,
    length: Column | None = None,
    max_length: int = MAX_LENGTH,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row a sequence: doc_id, chunk, start, length, bucket, bucket_length, batch, place, padding.

    bucket counts from 0 by length; every sequence of a bucket is padded to
    bucket_length. batch counts from 0 within the bucket; a batch holds
    ``token_budget // bucket_length`` sequences (at least one), and only a bucket's last
    batch may hold fewer. Sequences are dealt by a hash of doc_id and chunk, so batches
    mix sources and reruns agree; equal rows may swap places. An empty table gives no
    rows; other columns are ignored.
    """
    if min(max_length, buckets, token_budget) < 1:
        raise ValueError("max_length, buckets and token_budget must be positive")
    spark = docs.sparkSession
    seqs = cut(sequences(docs, length, max_length))
    found = seqs.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most max_length rows
    bounds = optimal_bounds([r["length"] for r in found], [r["n"] for r in found], buckets)
    array = F.array(*[F.lit(b).cast("long") for b in bounds or [max_length]])
    bucket = F.size(F.filter(array, lambda b: b < F.col("length")))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("chunk").cast("string")).cast("binary"))
    placed = seqs.withColumn("bucket", bucket.cast("int")).withColumn("_key", key)
    placed = placed.withColumn("_bin", F.substring("_key", 1, 3))
    placed = number(placed, ["bucket"], "_bin", [F.col(c) for c in ("_key", "doc_id", "chunk", "start", "length")], "_at")
    upper = F.element_at(array, F.col("bucket") + 1)
    cap = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / upper))
    return placed.select(
        "doc_id", "chunk", "start", "length", "bucket",
        upper.alias("bucket_length"),
        F.floor(F.col("_at") / cap).cast("long").alias("batch"),
        F.pmod(F.col("_at"), cap).cast("long").alias("place"),
        (upper - F.col("length")).alias("padding"),
    )
