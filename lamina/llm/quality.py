"""Quality rules as a short-circuit cascade.

Each rule is a bound on one feature of a text. On a sample of the table the cascade
measures what each rule costs and how many documents it rejects, orders the rules by
rejections per cost, and stops at the first rule that rejects. The order changes the
work only: a document is kept if every rule lets it pass.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import slices, texts

WINDOW, MIN_WORDS, MOST_TOP_WORD = 8, 20, 0.3
NOT_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))
CONTINUATION = bytes(range(0x80, 0xC0))
SAMPLE_ROWS = 500


class Features:
    """The features of one text, each computed when first asked for."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.raw.split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, CONTINUATION))

    def _n_symbols(self) -> int:
        return len(self.raw.translate(None, NOT_SYMBOL))

    def _n_marks(self) -> int:
        return self.raw.count(b"!!") + self.raw.count(b"...") + self.raw.count("…".encode())

    def _lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    def _n_stutters(self) -> int:
        return sum(map(eq, self.words, self.words[1:]))

    def _n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, its first place included.

    Windows are compared exactly: words become numbers, then each doubling of the width
    numbers the pairs of numbers at its half; ``window`` must be a power of two.
    """
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        found, ids = np.unique(pair, return_inverse=True)
        if len(found) == len(pair):
            return 0
        width *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``value`` is outside [least, most]. ``value`` gets the text's features."""

    name: str
    value: Callable[[Features], float]
    least: float = float("-inf")
    most: float = float("inf")

    def rejects(self, features: Features) -> bool:
        return not self.least <= self.value(features) <= self.most


def _per_word(name: str) -> Callable[[Features], float]:
    return lambda f: getattr(f, name) / max(1, f.n_words)


#: Texts as found on the web: too short, repeated, of symbols, shouted, of one word, of odd word lengths.
RULES = (
    Rule("words", lambda f: f.n_words, least=MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words - 30 * f.n_words, most=0),
    Rule("symbols", _per_word("n_symbols"), most=0.5),
    Rule("marks", _per_word("n_marks"), most=0.5),
    Rule("top_word", _per_word("top_word"), most=MOST_TOP_WORD),
    Rule("stutters", _per_word("n_stutters"), most=0.3),
    Rule("word_length", _per_word("word_chars"), least=2, most=20),
    Rule("repeated_lines", lambda f: f.n_dup_lines / max(1, len(f.lines)), most=0.5),
)


def first_rejection(features: Features, rules: tuple[Rule, ...]) -> str | None:
    """The name of the first rule in this order that rejects the text."""
    return next((r.name for r in rules if r.rejects(features)), None)


def order_of(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[int]:
    """The places of ``rules`` by rejections per second over ``sample``, greatest first; ties and an empty sample keep the given order.

    A rule's cost is its own: each is timed on texts of which nothing is computed yet.
    """
    scores = []
    for rule in rules:
        began, n = time.thread_time(), 0
        for raw in sample:
            n += rule.rejects(Features(raw))
        scores.append(n / max(time.thread_time() - began, 1e-9))
    return sorted(range(len(rules)), key=lambda i: (-scores[i], i))


def ordered(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """``rules`` in the order of ``order_of``; rules of one name are different rules."""
    return tuple(rules[i] for i in order_of(sample, rules))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[bytes]:
    """At most ``rows`` texts, for estimates of cost and selectivity only: the order of rules never changes a verdict.

    Those with the least hash of id and text, wherever they lie in the table. Of a longer
    text the first 64 KB stand for it here, so the driver holds a bounded sample; verdicts
    are on whole texts.
    """
    text = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.substring(F.col("text").cast("binary"), 1, 65_536).alias("t")).where("t is not null")
    # the hashes alone first: each task sends its least ones, and only the chosen texts follow
    least = text.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    chosen = text.where(F.col("h") <= F.lit(least)) if least is not None else text
    return [bytes(r["t"]).decode(errors="ignore").encode() for r in chosen.orderBy("h").limit(rows).collect()]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row a document.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. kept is
    the cascade's verdict, false where base_failed. A null text is as an empty one: no
    words, failed. Repeated rows each get a verdict; an empty table gives no rows; other columns are ignored. One pass
    over whole texts, no shuffle.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    order = order_of(sample_of(docs, sample_rows), rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = rules is RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = tuple((RULES if own else rules)[i] for i in order)
        for batch in slices(batches, 2000):
            rows = []
            for raw in texts(batch):
                f = Features(raw)
                verdict = first_rejection(f, cascade)
                base = f.n_words < MIN_WORDS or 100 * f.n_repeat_words > 30 * f.n_words
                rows.append((*(getattr(f, c) for c in counts), base, not base and verdict is None))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *counts, "base_failed", "kept"])

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that every rule lets pass; a text is worked on up to its first rejection.

    A null text is as an empty one; repeated rows each get a verdict; an empty table stays empty.
    """
    order, own = order_of(sample_of(docs, sample_rows), rules), rules is RULES

    @F.pandas_udf("boolean")
    def passes(column):
        cascade = tuple((RULES if own else rules)[i] for i in order)
        return column.map(lambda text: first_rejection(Features((text or "").encode()), cascade) is None)

    return docs.where(passes("text"))
