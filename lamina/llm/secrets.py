"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

A byte-level vocabulary spends few tokens on words and many on random characters. A
candidate run whose characters per token fall below ``max_ratio`` is reported, unless it
is a known digest or identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fresh, slices, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that may be keys: of the characters of keys, with dots inside. Their pieces lie between separators.
#: Least length of a key with a digit, and of one without: made-up words below 16 letters often look like keys.
LEAST, LEAST_LETTERS, PIECE = 12, 16, re.compile(r"[A-Za-z0-9]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
#: Digests of the usual lengths, UUIDs and plain numbers.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9.+-]+"
    r"|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})"
)
#: The same for one piece of a longer run; UUIDs in one; and names joined of words, short ones too, which only their pieces tell from keys.
KNOWN_PIECE = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
NAMES = re.compile(r"[A-Za-z]+(?:[_/=-]+(?:[A-Za-z]+|[0-9]+))*")
VOCABULARY, MAX_RATIO = "byte_bpe_50k.tiktoken", 2.2


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a rank file, once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the three patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _keys_within(run: str, vocabulary: str, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of ``run``, from separator to separator, that may be keys.

    A part begins and ends with a piece of at most ``max_ratio`` characters a token.
    Between those may lie pieces of fewer than 4 characters, which tell nothing alone;
    words, numbers and known digests end a part.
    """
    count = lambda text: len(encoding(vocabulary).encode_ordinary(text))
    known = [m.span() for m in UUID.finditer(run)]
    found, begin, end = [], None, None
    for m in PIECE.finditer(run):
        piece, at = m.group(), m.start()
        if any(a <= at < b for a, b in known) or piece.isdigit() and len(piece) > 3:
            begin = None
        elif len(piece) > 3:
            if not KNOWN_PIECE.fullmatch(piece) and len(piece) <= max_ratio * count(piece):
                if begin is None:
                    begin = at
                    found.append((begin, m.end()))
                found[-1] = (begin, m.end())
            else:
                begin = None
    return [(a, b) for a, b in found if _long(run[a:b]) and not KNOWN.fullmatch(run[a:b]) and b - a <= max_ratio * count(run[a:b])]


def _long(run: str) -> bool:
    return len(run) >= LEAST_LETTERS or len(run) >= LEAST and any(map(str.isdigit, run))


def random_spans(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """Parts of candidate runs between separators, or else whole runs, with at most ``max_ratio`` characters a token, but for known digests and identifiers."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not _long(run) or KNOWN.fullmatch(run):
            continue
        parts = _keys_within(run, vocabulary, max_ratio)
        if not parts and len(run) >= LEAST_LETTERS and "." not in run and any(c.isdigit() for c in run) and not NAMES.fullmatch(run):
            parts = [(0, len(run))] * (len(run) <= max_ratio * len(encoding(vocabulary).encode_ordinary(run)))
        found += [(m.start() + a, m.start() + b, "random") for a, b in parts]
    return found


def scan(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> tuple[list, list]:
    """The base spans and all spans, both by start and then kind as listed."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + random_spans(text, vocabulary, max_ratio), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch that spans cover replaced by one ``mark``."""
    out, at, end = [], 0, -1
    for start, stop, _ in sorted(spans):
        if start >= end:
            out += [text[at:start], mark]
        end = at = max(end, stop)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row a document.

    A null text is as an empty one: no spans, the digest of nothing. The whole text is
    scanned; repeated rows are each scanned; an empty table gives no rows; other columns
    are ignored. One pass, no shuffle.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            rows = []
            for raw in texts(batch):
                base, every = scan(raw.decode(), vocabulary, max_ratio)
                kinds = [s[2] for s in every]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, joined(every), kinds.count("random")))
            columns = list(zip(*rows))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``mark``; all rows and columns stay.

    n_chars, where there is such a column, is counted anew for changed texts; other
    documents are untouched, a null text stays null.
    """
    (clean,) = fresh(docs, "_clean")

    @F.pandas_udf("string")
    def clear(column):
        def one(text):
            spans = scan(text, vocabulary, max_ratio)[1] if text else None
            return redact(text, spans, mark) if spans else None

        return column.map(one)

    out = docs.withColumn(clean, clear("text"))
    changed = F.col(clean).isNotNull()
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length(clean).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(F.col(clean), F.col("text"))).select(*docs.columns)
