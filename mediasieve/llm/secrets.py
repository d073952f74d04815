"""Secret scan: fixed patterns, and random strings found by their token efficiency."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from mediasieve.llm.batches import bound_batches, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal digits.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
NAMED_DIGEST = re.compile(r"(md5|sha1|sha224|sha256|sha384|sha512)[-_=/]+(.*)", re.IGNORECASE | re.ASCII)
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPLIT = re.compile(r"[+/_=-]+")
#: Runs of letters alone with at most so many characters a token are no words; words of no language at hand come close to it.
LETTERS_PER_TOKEN = 2.0
SLICE = 1024

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chars_per_token", pa.float64())])))]
)


def _named_digest(text: str) -> bool:
    """The name of a hash function and a value of its length, hexadecimal or base64."""
    m = NAMED_DIGEST.fullmatch(text)
    if not m:
        return False
    n, value = DIGEST_BYTES[m[1].lower()], m[2]
    return len(value) == 2 * n and bool(re.fullmatch(r"[0-9A-Fa-f]+", value)) or len(value.rstrip("=")) == -(-4 * n // 3)


def _tokens(text: str, encoding) -> int:
    """Tokens of a run, cut into slices, as the time of an encoder may grow with the square of a run's length."""
    return sum(len(encoding.encode_ordinary(text[k : k + SLICE])) for k in range(0, len(text), SLICE))


def _word(part: str, encoding) -> bool:
    """Letters that encode as words do: few tokens, or one token where a word begins."""
    return len(part) > LETTERS_PER_TOKEN * _tokens(part, encoding) or len(part) < SLICE and _tokens(" " + part, encoding) == 1


def known(text: str, encoding) -> bool:
    """A digest, a UUID, a number, or an identifier made of words and numbers between separators."""
    if UUID.fullmatch(text) or _named_digest(text):
        return True
    if len(text) in DIGEST_LENGTHS and re.fullmatch(r"[0-9A-Fa-f]+", text):
        return True
    parts = [part for part in SPLIT.split(text) if part]
    return all(WORDLIKE.fullmatch(part) for part in parts) and all(part.isdigit() or _word(part, encoding) for part in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def load_encoding(path: str | None):
    import tiktoken

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random(text: str, encoding, max_chars_per_token: float) -> float | None:
    """Characters a token of a random string; None if it is none."""
    if known(text, encoding):
        return None
    ratio = len(text) / _tokens(text, encoding)
    return ratio if ratio <= max_chars_per_token else None


def scan(text: str, encoding, max_chars_per_token: float) -> list[tuple[int, int, int, float | None]]:
    """All spans of one text by start and kind."""
    base = base_spans(text)
    found: list[tuple[int, int, int, float | None]] = [(a, k, b, None) for a, k, b in base]
    # Runs come in order, so the furthest end of the base spans that begin before a run's end tells whether one touches it.
    ends = list(accumulate((b for _, _, b in base), max))
    starts = [a for a, _, _ in base]
    free = lambda a, b: not (n := bisect_left(starts, b)) or ends[n - 1] <= a
    for m in CANDIDATE.finditer(text):
        whole = free(*m.span())
        ratio = _random(m[0], encoding, max_chars_per_token) if whole else None
        if ratio is not None:
            found.append((m.start(), 3, m.end(), ratio))
            continue
        # Digests and other whole runs that are known aren't judged by parts.
        if whole and known(m[0], encoding):
            continue
        for part in PART.finditer(text, *m.span()):
            if part.span() != m.span() and free(*part.span()):
                ratio = _random(part[0], encoding, max_chars_per_token)
                if ratio is not None:
                    found.append((part.start(), 3, part.end(), ratio))
    return sorted(found)


def find_secrets(docs: DataFrame, encoding_path: str | None = None, max_chars_per_token: float = 2.2) -> DataFrame:
    """(doc_id, spans) for every row of ``docs(doc_id, text)``.

    Spans have a kind, start and end in code points (end exclusive), ordered by
    start and then kind. ``assign``, ``access`` and ``hex`` are leftmost
    non-overlapping matches of fixed patterns, each kind for itself. ``random``
    is the token-efficiency test: a run of 16 or more of ``A-Za-z0-9+/_=-``
    that touches no other span, is no known digest, UUID, number or identifier,
    and has at most ``max_chars_per_token`` characters for each token of the
    vocabulary at ``encoding_path`` (a rank file; ordinary words have more).
    The words of an identifier have more than ``LETTERS_PER_TOKEN`` themselves,
    or are one token. Of a run that isn't random as a whole (a path, say), the
    parts of 16 or more letters and digits are tested each for itself.

    Every row is its own unit of work: no shuffle, one Arrow batch at a time.
    Null text counts as empty and has no spans; repeated rows give repeated
    results; an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(encoding_path)
        for batch in slices(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "chars_per_token": r} for a, k, b, r in scan(t or "", encoding, max_chars_per_token)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, _SCHEMA.field("spans").type)], schema=_SCHEMA)

    bound_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,chars_per_token:double>>")
