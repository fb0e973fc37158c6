"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A vocabulary of sub-words spends few tokens on words and names and many on
random strings.  A candidate of few characters a token is reported, unless it
is a known digest or an identifier.  Candidates are the values that the
assignment pattern finds and other long runs of key characters; the test judges
them apart from the fixed patterns, so a string that both find has a span of each
kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretoken

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: One word as prose writes it; the shorter candidates must be more than that.
PROSE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_SIZES = frozenset((32, 40, 56, 64, 96, 128))
PARTING = re.compile(r"[_/+=-]+")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Words and a short number after them, or the number alone.
PART = re.compile(r"[A-Za-z]*[0-9]{0,4}")
#: One word in one case and a short number.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]*)[0-9]{0,4}")


@dataclass(frozen=True)
class Limits:
    """assign_chars, access_chars: least lengths of the base kinds.  chars_per_token: candidates at or below are random, unless a name's words all reach word_chars_per_token.

    prose_chars: a candidate below this length is left out if it is a single word
    of letters; many languages have words that an English vocabulary cuts short.
    """

    assign_chars: int = 12
    access_chars: int = 18
    chars_per_token: float = 2.0
    word_chars_per_token: float = 3.0
    prose_chars: int = 20


def identifier(s: str, encode, limits: Limits) -> bool:
    """Names in snake, kebab, camel or path form: words that take few tokens each, hardly any of under 3 letters, and short numbers only after them.

    Of three parts or more, each a word in one case, no tokens are asked for:
    words of other languages take many, and random strings do not fall like that.
    """
    parts = PARTING.split(s)
    if len(parts) >= 3 and all(PLAIN.fullmatch(x) for x in parts):
        return True
    if not all(PART.fullmatch(x) for x in parts):
        return False
    words = [w for x in parts for w in WORD.findall(x)]
    long = [w for w in words if len(w) >= 3]
    return sum(map(len, long)) >= 0.8 * sum(map(len, words)) and all(len(w) >= limits.word_chars_per_token * len(encode(w)) for w in long)


def known(s: str) -> bool:
    """Digests of usual lengths, UUIDs and plain numbers: not random secrets."""
    return bool(DIGEST.fullmatch(s)) and len(s) in DIGEST_SIZES or bool(UUID.fullmatch(s)) or s.isdigit()


def base_spans(text: str, limits: Limits) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, leftmost without overlap in each kind, in code points."""
    out = []
    low = text.lower()
    if any(hint in low for hint in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= limits.assign_chars]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= limits.access_chars]
    if len(text) >= 16:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def inefficient(s: str, encode, limits: Limits, assigned: bool = False) -> bool:
    """Whether a string costs so many tokens that it must be random: few characters a token, and neither a digest nor a name.

    assigned: it is the value of a password or key, where a string built like a
    digest is one more secret and no checksum.
    """
    bare = s.strip("=")
    if not any(c.isalpha() for c in s) or not assigned and known(bare) or len(s) > limits.chars_per_token * len(encode(s)):
        return False
    return not identifier(bare, encode, limits) and (len(s) >= limits.prose_chars or not PROSE.fullmatch(bare))


def random_spans(text: str, encode, limits: Limits) -> list[tuple[str, int, int]]:
    """Assigned values, and other long runs of key characters, that are inefficient."""
    values = []
    if any(hint in text.lower() for hint in HINTS):
        values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= limits.assign_chars]
    others = [m.span() for m in CANDIDATE.finditer(text)]
    if values:
        others = [(a, b) for a, b in others if not any(x < b and a < y for x, y in values)]
    found = [x for x in values if inefficient(text[slice(*x)], encode, limits, True)] + [x for x in others if inefficient(text[slice(*x)], encode, limits)]
    return [("random", a, b) for a, b in sorted(found)]


def scan_text(text: str, encode, limits: Limits = Limits()) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start and then kind as listed."""
    key = lambda x: (x[1], KINDS.index(x[0]))
    base = sorted(base_spans(text, limits), key=key)
    return base, sorted(base + random_spans(text, encode, limits), key=key)


SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


def scan(docs: DataFrame, limits: Limits = Limits(), vocabulary: str | None = None) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, start, end), in code points, end exclusive.

    A null text counts as empty and has no spans; a repeated row has its spans each time.  Columns of docs named base or
    spans are replaced, others pass through; rows are judged one by one, in
    place, without a shuffle; an empty table gives no rows.
    """
    docs = docs.drop("base", "spans").withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def run(batches):
        encode = pretoken.default_encoder(vocabulary).whole.encode_ordinary
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        names = ("kind", "start", "end")
        for batch in batches:
            found = [scan_text(t or "", encode, limits) for t in batch.column(at).to_pylist()]
            new = [pa.array([[dict(zip(names, s)) for s in x[k]] for x in found], arrow) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "base", "spans"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]).add("base", SPAN).add("spans", SPAN)
    return docs.mapInArrow(run, schema)
