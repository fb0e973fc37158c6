"""Line-first quality rules: each line is judged, failing lines go, and a document that loses too much goes too."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as B

# Phrases of page furniture, in lower case, by language.
BOILERPLATE = (
    # English
    "accept cookies", "accept all", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us on",
    "forgot your password", "javascript is disabled", "licensed under", "log in", "lorem ipsum", "newsletters", "newsletter", "next page", "previous page",
    "privacy policy", "read more", "released under the mit", "share on", "sign in", "sign up", "skip to content", "subscribe", "terms of service",
    "terms of use", "this work is licensed", "use of cookies", "uses cookies",
    # German
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "javascript aktivieren", "jetzt anmelden", "mehr lesen",
    "nach oben", "passwort vergessen", "verwendet cookies", "zum inhalt springen",
    # French
    "accepter les cookies", "cliquez ici", "conditions d'utilisation", "en savoir plus", "lire la suite", "mentions légales", "mot de passe oublié", "page suivante",
    "politique de confidentialité", "retour en haut", "se connecter", "tous droits réservés", "utilise des cookies",
    # Spanish
    "aceptar cookies", "aviso legal", "condiciones de uso", "haga clic aquí", "iniciar sesión", "leer más", "política de privacidad", "saltar al contenido",
    "todos los derechos reservados", "utiliza cookies", "volver arriba",
)
SYMBOLS = b"#*$%&|<>"
ENDS = (".", "!", "?", "…", "。", "！", "？", "।", "؟", ":", ";")
CLOSERS = "\"')]}”’»›」』）"


@dataclass(frozen=True)
class Rules:
    """Bounds of the line rules and of the verdicts.

    A line fails when it has no sentence end (a long line may have them within),
    when bars part its words as in a menu, when symbols take up too many of its
    characters, when most of its letters are capitals although it is long, when
    one word makes up most of it, or when a short line holds a phrase of page
    furniture.
    """

    most_symbols: float = 0.1  # of a line's characters
    least_bars: int = 3
    words_per_bar: int = 8  # lines with a bar for so many words or fewer are menus
    long_line: int = 12  # words; such a line may end without a sentence end
    words_per_end: int = 60  # if one word in so many has one
    most_capitals: float = 0.7  # of the letters of a line of 4 words or more
    most_one_word: float = 0.5  # of a line of 8 words or more
    furniture_words: int = 16  # longer lines are not furniture
    most_loss: float = 0.5  # of a document's word characters
    least_words: int = 50
    most_repeat: float = 0.5  # of the words, in 3-word windows that recur


def _flag(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


IS_END, IS_SYMBOL, IS_UPPER, IS_LOWER = _flag(b".!?"), _flag(SYMBOLS), _flag(bytes(range(65, 91))), _flag(bytes(range(97, 123)))
#: Last bytes of the ends and closers; the whole character is then compared.
TAIL = tuple(x.encode() for x in (*ENDS, *CLOSERS))
FURNITURE = tuple(x.encode() for x in BOILERPLATE)


def _joins(raw: bytes, at: int) -> bool:
    """Whether the character that holds this byte continues a word."""
    if raw[at] < 0x80:
        return raw[at : at + 1].isalnum() or raw[at] == 95
    a, b = at, at + 1
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    c = raw[a:b].decode(errors="replace")
    return c.isalnum() or unicodedata.category(c[0])[0] == "M"


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _recurring(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back] > 1


def judge(data: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text, and of each line its span, its text and whether it stays."""
    solid = ~B.IS_SPACE[data]
    starts, ends, owner = B.spans(solid, off)
    h = B.hashes(data, starts, ends)
    points = _sums((data & 0xC0) != 0x80)
    n_words = np.bincount(owner, minlength=len(off) - 1)
    chars = points[ends] - points[starts]
    word_chars = np.bincount(owner, chars, len(off) - 1).astype(np.int64)
    salt = B.mix(np.arange(1, len(off), dtype=np.uint64))
    runs, first = B.windows(h, owner, 3)
    again = first[_recurring(B.mix(runs ^ salt[owner[first]]))]
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[again + k] = True
    n_repeat = np.bincount(owner[repeated], minlength=len(off) - 1)

    # Lines: every text has one more than it has line feeds.
    feeds = np.flatnonzero(data == 10)
    n_feeds = np.diff(np.searchsorted(feeds, off))
    line_owner = np.repeat(np.arange(len(off) - 1), n_feeds + 1)
    lo = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    hi = np.sort(np.concatenate([off[1:], feeds]), kind="stable")
    w_lo, w_hi = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    words = w_hi - w_lo
    worded = np.flatnonzero(words)
    _, place = np.unique(B.mix(B.hashes(data, lo[worded], hi[worded]) ^ salt[line_owner[worded]]), return_index=True)
    n_dup = np.bincount(line_owner[worded], minlength=len(off) - 1) - np.bincount(line_owner[worded[place]], minlength=len(off) - 1)

    def of_line(flags):
        total = _sums(flags)
        return total[hi] - total[lo]

    symbols, upper, lower = of_line(IS_SYMBOL[data]), of_line(IS_UPPER[data]), of_line(IS_LOWER[data])
    chars_total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = chars_total[w_hi] - chars_total[w_lo]
    fails = symbols > rules.most_symbols * np.maximum(line_chars, 1)
    fails |= (words >= 4) & (upper > rules.most_capitals * np.maximum(upper + lower, 1))
    ended = np.zeros(len(lo), bool)
    stop = ends[np.maximum(w_hi - 1, 0)] if len(ends) else np.zeros(len(lo), np.int64)
    for tail in TAIL:
        same = words > 0
        for k, byte in enumerate(reversed(tail)):
            same = same & (data[np.maximum(stop - 1 - k, 0)] == byte) if len(data) else same
        ended |= same
    inner = np.concatenate([[0], np.cumsum(IS_END[data[ends - 1]])]) if len(ends) else np.zeros(1, np.int64)
    ended |= (words >= rules.long_line) & ((inner[w_hi] - inner[w_lo]) * rules.words_per_end >= words)
    fails |= ~ended
    bars = of_line(data == ord("|"))
    fails |= (bars >= rules.least_bars) & (bars * rules.words_per_bar >= words)
    # One word for most of a long line: it then stands twice within three words somewhere.  Of such lines' sorted
    # hashes the median is the commonest word, if one has over half of them.
    near = np.zeros(len(h), bool)
    near[:-1] = h[:-1] == h[1:]
    near[:-2] |= h[:-2] == h[2:]
    near = _sums(near)
    for i in np.flatnonzero((words >= 8) & ~fails & (near[w_hi] > near[w_lo])):
        own = h[w_lo[i] : w_hi[i]]
        if (own == np.partition(own, len(own) // 2)[len(own) // 2]).sum() > rules.most_one_word * len(own):
            fails[i] = True
    raw = data.tobytes().lower()  # A-Z alone
    for phrase in FURNITURE:
        at = raw.find(phrase)
        while at >= 0:
            i, end = np.searchsorted(lo, at, "right") - 1, at + len(phrase)
            # the texts stand without a gap: a line's ends are word borders
            whole = end <= hi[i] and not (at > lo[i] and _joins(raw, at - 1)) and not (end < hi[i] and _joins(raw, end))
            if whole and words[i] <= rules.furniture_words:
                fails[i] = True
            at = raw.find(phrase, at + 1)
    fails &= words > 0
    lost = np.bincount(line_owner[fails], line_chars[fails], len(off) - 1)
    base_failed = (n_words < rules.least_words) | (n_repeat > rules.most_repeat * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": B.per_text(IS_SYMBOL[data], off), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (lost <= rules.most_loss * word_chars), "n_lines_failed": np.bincount(line_owner[fails], minlength=len(off) - 1),
        "_line": np.stack([lo, hi, line_owner]), "_fails": fails,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_failed")


def _runner(rules: Rules, at: int, keep_text: bool, drop: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.chunks(batch.column(at)):
                x = judge(data, off, rules)
                own = batch.slice(lo, hi - lo)
                columns = list(own.columns)
                if keep_text:
                    columns[at] = _cleaned(columns[at], data, off, x)
                columns += [pa.array(x[c].astype(np.int64)) for c in COUNTS] + [pa.array(x["base_failed"]), pa.array(x["kept"])]
                out = pa.RecordBatch.from_arrays(columns, names=[*own.schema.names, *COUNTS, "base_failed", "kept"])
                yield out.filter(pa.array(x["kept"])) if drop else out

    return run


def _cleaned(texts: pa.Array, data: np.ndarray, off: np.ndarray, x: dict) -> pa.Array:
    """The texts without their failing lines."""
    touched = np.flatnonzero(x["n_lines_failed"])
    out = texts.to_pylist()
    lo, hi, owner = x["_line"]
    for i in touched.tolist():
        a, b = np.searchsorted(owner, [i, i + 1])
        out[i] = b"\n".join(data[lo[k] : hi[k]].tobytes() for k in range(a, b) if not x["_fails"][k]).decode()
    return pa.array(out, texts.type)


def line_quality(docs: DataFrame, rules: Rules = Rules(), clean: bool = False, drop: bool = False) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_failed, base_failed and kept.

    Words are runs without ASCII white space.  clean: text is replaced by its
    passing lines; drop: only kept rows are returned.  A null or empty text has
    no words and fails.  Columns of docs with one of the new names are replaced;
    all others pass through; rows are judged one by one, in place, without a
    shuffle.  Rows are judged alike however often they repeat; an empty table
    gives no rows.
    """
    added = [*COUNTS, "base_failed", "kept"]
    docs = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])
    return docs.mapInArrow(_runner(rules, docs.columns.index("text"), clean, drop), schema)
