import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import linededup, linerules

WS = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_dedup(pairs, chars=20, docs=3):
    key = lambda line: line.strip(WS).translate(FOLD)
    held = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held.setdefault(key(line), set()).add(i)
    common = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def dedup(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect()), key=repr)


def test_dedup_as_brute_force(table, odd):
    rng = random.Random(5)
    lines = [f"A line number {i} that is long enough." for i in range(12)] + ["short", "", " \t", "Ä line with ümlauts of some length"]
    pairs = [(rng.randrange(40), "\n".join(rng.choice([x, x.upper(), f" {x}\r"]) for x in rng.choices(lines, k=rng.randrange(1, 9)))) for _ in range(60)]
    assert dedup(table(pairs)) == brute_dedup(pairs)
    assert dedup(table(odd, clash=True)) == brute_dedup(odd)
    assert dedup(table([])) == []


def test_dedup_is_native(table):
    plan = linededup.dedup_lines(table([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_base_as_brute_force(table, odd):
    rng = random.Random(8)
    pairs = [(k, "".join(rng.choice(["a", "bb", "中é", " ", "  ", "\n", "\t", "\x0b", "#", "|", ".", " "]) for _ in range(rng.choice([0, 5, 60, 900])))) for k in range(120)] + odd
    got = sorted(((r["doc_id"], *[r[c] for c in BASE]) for r in linerules.line_quality(table(pairs, clash=True)).collect()), key=repr)
    assert got == sorted(((i, *brute_base(t)) for i, t in pairs), key=repr)
    assert linerules.line_quality(table([])).count() == 0


def test_words_and_lines_of_equal_sums(table):
    """Thue-Morse words, on which polynomial hashes modulo 2 ** 64 collide, are told apart."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    pairs = [(1, f"{a}\n{b}\n{a}"), (2, f"{a} x y {b} x y"), (3, f"{a[:32]} x y {b[:32]} x y {a[:32]} x y")]
    got = sorted((r["doc_id"], *[r[c] for c in BASE]) for r in linerules.line_quality(table(pairs)).collect())
    assert got == [(i, *brute_base(t)) for i, t in pairs] and got[0][4] == 1 and got[1][5] == 0


WORDS = "river town bridge stone light evening people walk banks water cloud field".split()
#: Eight lines in which no three words recur.
PROSE = "\n".join("The " + " ".join(f"{w}{chr(97 + i)}" for w in WORDS) + " end." for i in range(8))


@pytest.mark.parametrize(
    "extra, kept, left",
    [
        ("", True, 8),
        ("\nAll rights reserved.", True, 8),
        ("\nHome | News | Sport | About | Contact us.", True, 8),
        ("\n" + " ".join(f"{a}{b}UY!! NOW{a}{b}!!" for a in "ABCDEFGHIJKL" for b in "ABCDEFGHIJKL"), False, 8),
        ("\n" + " | ".join(f"word{i}" for i in range(300)), False, 8),
        ("\n" + " ".join(f"a{i}$$$ b{i}***" for i in range(200)) + ".", False, 8),
        ("\n" + "\n".join(f"no{i} end{i} of{i} line{i} here{i}" for i in range(60)), False, 8),
        ("\nOne more line ends well.", True, 9),
    ],
)
def test_line_rules(table, extra, kept, left):
    r = linerules.line_quality(table([(1, PROSE + extra)]), clean=True).first()
    assert r["kept"] is kept and not r["base_failed"] and len(r["text"].split("\n")) == left


def brute_line_fails(line):
    """The rules on one line, from their description."""
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    if not words:
        return False
    n, chars = len(words), sum(map(len, words))
    upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
    phrase = "|".join(map(re.escape, linerules.BOILERPLATE))
    return any((
        len(re.findall(r"[#*$%&|<>]", line)) > 0.1 * chars,
        n >= 4 and upper > 0.7 * (upper + lower) and upper + lower > 0,
        not words[-1].endswith((*linerules.ENDS, *linerules.CLOSERS)) and not (n >= 12 and 60 * sum(w[-1] in ".!?" for w in words) >= n),
        line.count("|") >= 3 and 8 * line.count("|") >= n,
        n >= 8 and max(map(words.count, words)) > 0.5 * n,
        n <= 16 and re.search(rf"(?<!\w)(?:{phrase})(?!\w)", line, re.IGNORECASE | re.ASCII if line.isascii() else re.IGNORECASE) is not None,
    ))


def test_verdicts_as_brute_force(table):
    rng = random.Random(12)
    pool = ["river", "stone", "The", "NASA", "USA", "x.", "end.", "why?", "no!", "|", "|", "##", "$5", "log", "in", "sign", "up", "Read", "more", "é", "中文。", "done”", "a:", "(b)", "cookie", "policy", "blog"]
    pairs = []
    for k in range(300):
        lines = [" ".join(rng.choices(pool, k=rng.choice([1, 3, 6, 9, 14, 18, 30]))) + rng.choice(["", ".", ".", "."]) for _ in range(rng.randrange(1, 9))]
        pairs.append((k, rng.choice(["", PROSE + "\n"]) + "\n".join(lines)))
    got = {r["doc_id"]: r for r in linerules.line_quality(table(pairs)).collect()}
    for k, text in pairs:
        lines = text.split("\n")
        lost = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in lines if brute_line_fails(x))
        n, chars, *_, failed = brute_base(text)
        assert (got[k]["n_lines_failed"], got[k]["kept"]) == (sum(map(brute_line_fails, lines)), not failed and lost <= 0.5 * chars), text


@pytest.mark.parametrize(
    "line, left",
    [
        ("She studied design in Milan for three years.", 9),
        ("Their dialog in the last scene is short.", 9),
        ("She wrote on her blog in spring.", 9),
        ("He made the thread more even.", 9),
        ("The \u00e9log in of old was long.", 9),
        ("Sign in.", 8),
        ("Please \u201clog in\u201d first.", 8),
        ("A blog in which you log in.", 8),
        ("Get our newsletters.", 8),
        ("Alle Rechte vorbehalten.", 8),
        ("Politique de confidentialité.", 8),
        ("Es importante leer más.", 8),
    ],
)
def test_furniture_between_word_borders(table, line, left):
    pairs = [(k, x) for k, x in enumerate(["Word", PROSE + "\n" + line, line + "\n" + PROSE, "Word"])]
    got = {r["doc_id"]: r["text"] for r in linerules.line_quality(table(pairs, parts=1), clean=True).collect()}
    assert [len(got[k].split("\n")) for k in (1, 2)] == [left, left]


def test_clean_and_drop(table):
    df = linerules.line_quality(table([(1, PROSE + "\nSign in to read more."), (2, "too short."), (3, None)]), clean=True, drop=True)
    (r,) = df.collect()
    assert r["doc_id"] == 1 and r["text"] == PROSE and r["source"] == "s"


def test_hash_of_kept_text(table):
    r = linededup.dedup_lines(table([(1, "ä\nb")])).select(F.sha2("text", 256).alias("x")).first()
    assert r["x"] == hashlib.sha256("ä\nb".encode()).hexdigest()
