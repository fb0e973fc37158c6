"""Byte-level BPE ids of many texts at once, with a cache of pre-tokens.

The vocabulary's pattern cuts a text into pre-tokens that are encoded one by
one.  Texts of code points below 0x250 (Latin scripts) are cut by array
operations, and a pre-token seen before costs one table look-up, which compares
its bytes.  Any other text goes through the vocabulary's own pattern.  Both ways
give the ids that the `tokenizers` library gives for the same vocabulary (tests
compare them).
"""

from __future__ import annotations

import base64
import json
import unicodedata

import numpy as np
import regex

from . import bytewords as B

LATIN = 0x250
LETTER, NUMBER, SPACE, OTHER = range(4)


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LATIN)], np.uint8)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


def cut(cp: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of code points cp < LATIN; off: where each text begins, and the end."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[cp]
    first = np.zeros(n + 1, bool)
    first[off] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    joined = np.zeros(n, bool)  # the character before is this text's and a plain space
    joined[1:] = (cp[:-1] == 32) & ~first[1:-1]
    start = run & (blank | ~joined)
    # the last character of white space stands with what follows, or alone
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:-1]
    quote = np.flatnonzero((cp == 39) & run & ~joined)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        a = cp[quote + 1]
        b = cp[np.minimum(quote + 2, n - 1)]
        b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
        start[after[after < n]] = True
    return np.flatnonzero(start)


#: Bytes of a pre-token that the table holds; longer ones are looked up as Python bytes.
HELD = 24


class Encoder:
    """Ids by a .tiktoken vocabulary file.

    added: strings that are one token wherever they stand in a text, with their
    ids.  Without them such strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None, most_entries: int = 400_000, slots: int = 1 << 20):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {k.encode(): v for k, v in (added or {}).items()}
        self.parting = regex.compile(b"|".join(regex.escape(k) for k in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.classes = _classes()
        self.most, self.mask = most_entries, B.U64(slots - 1)
        self.clear()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.key = [np.zeros(size, np.uint64) for _ in range(HELD // 8)]
        self.length = np.zeros(size, np.uint8)  # 0: a free slot
        self.entry = np.zeros(size, np.int32)
        self.known: dict[bytes, int] = {}
        self.begin = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)
        self.entries = self.used = 0

    def _add(self, pieces: list[str]) -> None:
        ids = list(map(self.whole._core_bpe.encode_ordinary, pieces))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total, k = int(sizes.sum()), self.entries + len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.begin[self.entries : k] = self.used + np.cumsum(sizes) - sizes
        self.count[self.entries : k] = sizes
        self.pool[self.used : self.used + total] = [x for y in ids for x in y]
        self.used, self.entries = self.used + total, k

    def look_up(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The cache entry of each pre-token data[start : next start].

        A slot of the table counts only if its bytes and length are those of the
        pre-token; whatever the table does not hold is looked up in a dict.
        """
        if self.entries > self.most:
            self.clear()
        size = np.diff(np.append(starts, len(data)))
        from_here = B.eights(data)
        slot, parts = size.astype(np.uint64), []
        for k in range(0, HELD, 8):
            part = np.zeros(len(starts), np.uint64)
            some = np.flatnonzero(size > k) if k else slice(None)
            part[some] = from_here[starts[some] + k] & B.FIRST[np.minimum(size[some] - k, 8)]
            slot[some] = B.mix(slot[some] ^ part[some])
            parts.append(part)
        slot = (slot & self.mask).astype(np.int64)
        entry = self.entry[slot].astype(np.int64)
        same = self.length[slot] == size
        for held, part in zip(self.key, parts):
            same &= held[slot] == part
        miss = np.flatnonzero(~same)
        if len(miss):
            raw, fresh = data.tobytes(), []
            for i in miss.tolist():
                piece = raw[starts[i] : starts[i] + size[i]]
                at = self.known.get(piece)
                if at is None:
                    at = self.known[piece] = self.entries + len(fresh)
                    fresh.append(piece.decode())
                entry[i] = at
            self._add(fresh)
            short = miss[size[miss] <= HELD]
            # of several that meet in a slot one must win as a whole
            where, last = np.unique(slot[short][::-1], return_index=True)
            short = short[::-1][last]
            self.length[where], self.entry[where] = size[short], entry[short]
            for held, part in zip(self.key, parts):
                held[where] = part[short]
        return entry

    def ids_of(self, entry: np.ndarray) -> np.ndarray:
        count = self.count[entry].astype(np.int64)
        stop = np.cumsum(count)
        return self.pool[np.repeat(self.begin[entry] - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)]

    def pretokens(self, data: np.ndarray, off: np.ndarray):
        """For texts of Latin code points: (code points, their offsets by text, starts, text of each start, entry of each)."""
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        at = np.zeros(len(off), np.int64)
        np.cumsum(B.per_text(lead, off), out=at[1:])
        starts = cut(cp, at, self.classes)
        entry = self.look_up(data, starts if len(cp) == len(data) else np.flatnonzero(lead)[starts])
        return cp, at, starts, np.searchsorted(at, starts, "right") - 1, entry

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has)."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        parted = [m.start() for m in self.parting.finditer(data.tobytes())] if self.parting else []
        if not parted and data.max() < 0xC9:
            _, _, _, owner, entry = self.pretokens(data, off)
            sizes = np.bincount(owner, self.count[entry], n).astype(np.int64)
            return self.ids_of(entry), sizes
        apart = set(np.searchsorted(off, parted, "right") - 1)
        parts, sizes = [], np.zeros(n, np.int64)
        for i in range(n):
            own = data[off[i] : off[i + 1]]
            ids = self._parted(own.tobytes()) if i in apart else self._one(own)
            parts.append(ids)
            sizes[i] = len(ids)
        return np.concatenate(parts), sizes

    def _one(self, own: np.ndarray) -> np.ndarray:
        if len(own) and own.max() >= 0xC9:
            return np.array(self.whole.encode_ordinary(own.tobytes().decode("utf-8")), np.uint32)
        if not len(own):
            return np.zeros(0, np.uint32)
        return self.ids_of(self.pretokens(own, np.array([0, len(own)]))[4])

    def _parted(self, raw: bytes) -> np.ndarray:
        """The ids of a text with added tokens in it: what stands between them is encoded for itself."""
        out, at = [], 0
        for m in self.parting.finditer(raw):
            out += [self._one(np.frombuffer(raw[at : m.start()], np.uint8)), np.array([self.added[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._one(np.frombuffer(raw[at:], np.uint8))])


def default_encoder(path: str | None = None, added: dict[str, int] | None = None) -> Encoder:
    """The encoder of the public 50,257-entry byte-level vocabulary; path: its .tiktoken file."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizers file, as it lists them."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
