"""Secret spans: three base patterns and a token-efficiency test.

The test looks at runs of token characters (letters, digits, ``+/_=-``) of
``MIN_RUN`` characters or more. A public byte vocabulary spends few tokens on words
and many on random strings, so runs with fewer than ``MAX_CHARS_PER_TOKEN``
characters a token are random; runs without a digit may be words of a language that
the vocabulary does not know well, so they need ``MAX_OF_LETTERS``. Known digests
(pure hexadecimal of a digest's length), UUIDs, and identifiers (parts between
``_ - / = +`` that are all words or short numbers; runs without a letter) are
excluded, as are runs that touch a base span.

Edge cases: a null text is empty and has no spans; long texts are scanned whole;
repeated rows and ties are scanned alike; an empty table gives no rows; other
columns are not read (the filter form keeps them).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, vocabulary_path

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
MIN_RUN = 20
MAX_CHARS_PER_TOKEN = 2.1
MAX_OF_LETTERS = 1.8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def is_identifier(run: str) -> bool:
    """Whether every part of a run is a word or a short number, as in file_names-2024."""
    parts = [p for p in re.split(r"[+/_=-]+", run) if p]
    return len(parts) > 1 and all(p.isalpha() and (p.islower() or p.isupper() or p.istitle()) and len(p) <= 12 or p.isdigit() and len(p) <= 8 for p in parts)


def random_spans(text: str, base: list[tuple[int, int, str]], tokens, min_run: int = MIN_RUN, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """Runs that the vocabulary finds random; ``tokens`` counts a string's tokens."""
    if not any(len(chunk) >= min_run for chunk in text.split()):
        return []
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        if len(run) < min_run or not re.search("[A-Za-z]", run):
            continue
        if _UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and _ALL_HEX.fullmatch(run) or is_identifier(run):
            continue
        if any(s < m.end() and m.start() < e for s, e, _ in base):
            continue
        if len(run) < (limit if re.search("[0-9]", run) else min(limit, MAX_OF_LETTERS)) * tokens(run):
            out.append((m.start(), m.end(), "random"))
    return out


def _encoding(ranks: bytes):
    def make():
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    return held(("ranks", hashlib.blake2b(ranks).hexdigest()), make)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, and all spans."""
    spark = docs.sparkSession
    with open(vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        tokens = lambda s: len(encoding.encode_ordinary(s))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                base = base_spans(t := text.as_py() or "")
                spans = sorted(base + random_spans(t, base, tokens), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                kinds = [k for *_, k in base]
                digest = hashlib.sha256(_joined(s for s in spans if s[2] != "random").encode()).hexdigest()
                out.append((doc_id.as_py(), *(kinds.count(k) for k in KINDS[:3]), digest, _joined(spans)))
            if out:
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text").mapInArrow(run, schema)


def merge_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans as one, named after the first."""
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, k))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    at, parts = 0, []
    for s, e, k in merge_spans(spans):
        parts += [text[at:s], f"[{k}]"]
        at = e
    return "".join(parts) + text[at:]


def redact_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``; ``n_chars``, if there, is counted anew."""
    spark = docs.sparkSession
    with open(vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        tokens = lambda s: len(encoding.encode_ordinary(s))
        for batch in batches:
            texts, sizes = [], batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for k, text in enumerate(batch.column("text")):
                t = text.as_py()
                base = base_spans(t or "")
                if spans := base + random_spans(t or "", base, tokens):
                    t = redact(t, spans)
                    if sizes is not None:
                        sizes[k] = len(t)
                texts.append(t)
            new = {"text": pa.array(texts, pa.string())}
            if sizes is not None:
                new["n_chars"] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    cast = [f"cast({n} as {'string' if n == 'text' else 'bigint'}) AS {n}" if n in ("text", "n_chars") else f"`{n}`" for n in docs.columns]
    sized = docs.selectExpr(*cast)
    return sized.mapInArrow(run, sized.schema)
