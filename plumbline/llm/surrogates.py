"""Surrogates for personal data; DataFrame functions only.

Detected entities get keyed replacements of the same type: an address for an
address, a valid card or account number for a valid one, a name of the same
gender and script in the same case and layout.  One entity has one surrogate in
all documents (a surname behind a title, within a full name and alone in a text
that names its bearer so, a phone number in any layout).  Different entities have
different ones: surrogates that meet each other or a real entity are drawn again,
from a wider range after some turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import meeting, saved

# Titles and given names that mark a person, by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "Signora", "г-жа", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul George Andrew Henry Martin Hans Klaus Jürgen Wolfgang Karl Stefan Jean Pierre Jacques "
        "Michel Philippe Louis François José Juan Carlos Luis Miguel Javier Pedro Иван Сергей Алексей Дмитрий Γιώργος Νίκος"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Anna Emma Julia Laura Ursula Monika Petra Sabine Heike Marie Jeanne Sophie Camille "
        "Isabelle Claire Élise María Carmen Ana Lucía Isabel Rosa Елена Ольга Наталья Мария Ελένη Σοφία"
    ).split(),
}
#: Turns after which surrogates are drawn from a wider range, and after which no more are tried.
WIDER, LAST = 4, 100
#: Syllables of surrogate names by script, and how given names end by gender.
SYLLABLES = {
    "latin": ("ba be bo da de di ka ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(), {"m": ("n", "r", "s", "k"), "f": ("a", "ia", "ina", "ela"), "n": ("o", "e", "i", "y")}),
    "cyrillic": ("ба бе бо да де ди ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(), {"m": ("н", "р", "с", "к"), "f": ("а", "ия", "ина", "ела"), "n": ("о", "е", "и", "у")}),
    "greek": ("βα βε βο δα δε δι κα κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε φι φο".split(), {"m": ("ος", "ης", "ων", "ας"), "f": ("α", "η", "ια", "ινα"), "n": ("ο", "ι", "ε", "υ")}),
}

NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_titles = "|".join(sorted((t for x in TITLES.values() for t in x), key=lambda t: (-len(t), t)))
_given = "|".join(sorted((g for x in GIVEN.values() for g in x), key=lambda g: (-len(g), g)))
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Patterns by type; where two could begin at one place, the first listed is taken.  A look at the first
#: character comes before everything that costs more.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?=[A-Z][A-Z]\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?=\d)(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?![\d]|\.\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7})(?![A-Za-z0-9])",
    "phone": r"(?=[\d(+])(?:(?<![\d(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d))",
    "person": rf"(?=[A-Z\u00C0-\u00DE\u0370-\u03FF\u0410-\u042Fг])(?<!\p{{L}})(?:(?:{_titles})\.? {NAME}(?: {NAME})?|(?:{_given}) {NAME}|{NAME} {NAME}(?=,? [<(]?[A-Za-z0-9._%+-]++@))",
}
#: Cheap tests that every text with an entity passes: an @, a digit with five of a number's characters behind it, the head of an account number, a person.
HINT = rf"@|[0-9][0-9 .()-]{{5}}|[A-Z][A-Z][0-9]|{PATTERNS['person']}"
#: All types in one pattern.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
SCRIPTS = (("cyrillic", r"^\p{IsCyrillic}"), ("greek", r"^\p{IsGreek}"))


def holds_some(text: Column) -> Column:
    """Whether a text has an entity; false for null.  The full pattern runs only where the cheap one finds a hint."""
    return F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))


def bound(value: Column, body) -> Column:
    """body(value), with value computed once although body loops over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entities(text: Column) -> Column:
    """The entities of a text as they stand there, in order."""
    return F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))


def _noise(key: str, *of) -> Column:
    """128 hexadecimal digits that only the key's holder can compute from the entity."""
    parts = F.concat_ws("\x1f", F.lit(key), *of)
    return F.concat(F.sha2(parts, 256), F.sha2(F.concat(parts, F.lit("\x1e")), 256))


def _number(noise: Column, at, below: int) -> Column:
    """A number under `below` from four hexadecimal digits at place `at` (from 0; they wrap)."""
    return (F.conv(F.substr(noise, F.pmod(F.lit(4) * at, F.lit(124)).cast("int") + 1, F.lit(4)), 16, 10).cast("long") % below).cast("int")


def _alike(value: Column, noise: Column) -> Column:
    """value with each digit and letter replaced by another of its class and case, all else kept."""
    def one(c, i):
        digit, letter = F.substr(F.lit("0123456789"), _number(noise, i, 10) + 1, F.lit(1)), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(noise, i, 26) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), digit).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _valid_card(value: Column, real: Column) -> Column:
    """value with its last digit set so that it is valid if, and only if, real is."""
    body = F.substr(value, F.lit(1), F.length(value) - 1)
    right = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
    valid = F.pmod(_luhn(real), F.lit(10)) == 0
    wrong = F.pmod(right + 1 + _number(F.sha2(real, 512), 3, 9), F.lit(10))
    return F.concat(body, F.when(valid, right).otherwise(wrong).cast("string"))


def _mod97(text: Column) -> Column:
    """The remainder by which account numbers are checked; A is 10, Z is 35."""
    def step(left, c):
        return F.when(c.rlike("^[0-9]$"), F.pmod(left * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).when(c == "", left).otherwise(F.pmod(left * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _valid_iban(value: Column, real: Column) -> Column:
    """value with check digits that are right if, and only if, real's are."""
    country, body = F.left(value, F.lit(2)), F.substr(value, F.lit(5), F.length(value))
    right = F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))
    valid = _mod97(F.concat(F.substr(real, F.lit(5), F.length(real)), F.left(real, F.lit(4)))) == 1
    wrong = F.pmod(right + 1 + _number(F.sha2(real, 512), 5, 90), F.lit(97))
    return F.concat(country, F.lpad(F.when(valid, right).otherwise(wrong).cast("string"), 2, "0"), body)


def _name(kind: Column, gender: Column, script: Column, noise: Column, more: int) -> Column:
    """A name of three syllables and `more`, or one more, given names with their gender's ending."""
    out = None
    for name, (syllables, endings) in SYLLABLES.items():
        pool = F.array(*map(F.lit, syllables))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2 + more) + _number(noise, F.lit(9), 2)), lambda i: F.element_at(pool, _number(noise, i + F.when(i > 7, 2).otherwise(0), len(syllables)) + 1)), "")
        end = reduce(lambda done, g: done.when(gender == g, F.element_at(F.array(*map(F.lit, endings[g])), _number(noise, F.lit(8), len(endings[g])) + 1)), ("m", "f"), F.when(kind == "family", F.lit(""))).otherwise(F.element_at(F.array(*map(F.lit, endings["n"])), _number(noise, F.lit(8), len(endings["n"])) + 1))
        out = F.when(script == name, F.concat(stem, end)) if out is None else out.when(script == name, F.concat(stem, end))
    return F.initcap(out)


def _candidate(key: str, turn: int) -> Column:
    """The surrogate drawn for a unit (kind, gender, script, norm) at a turn; later turns draw longer names, and private addresses from a wider net."""
    norm, kind = F.col("norm"), F.col("kind")
    noise = _noise(key, kind, norm, F.lit(str(turn)))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host = F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1)
    email = F.concat(_alike(local, noise), F.lit(f"{turn // WIDER}" if turn >= WIDER else ""), F.lit("@"), _alike(host, _noise(key, F.lit("domain"), host)), F.regexp_extract(domain, r"(\.[^.]+)$", 1))
    octets = F.split(norm, "\\.")
    private = norm.rlike(r"^(10|127|192\.168|172\.(1[6-9]|2\d|3[01]))\.")
    second = _number(noise, F.lit(1), 256).cast("string")
    near = F.concat_ws(".", F.element_at(octets, 1), F.element_at(octets, 2)) if turn < WIDER else F.concat_ws(".", F.when(norm.startswith("127."), "127").otherwise("10"), second)
    head = F.when(private, near).otherwise(F.concat_ws(".", (_number(noise, F.lit(0), 80) + 20).cast("string"), second))
    ip = F.concat_ws(".", head, _number(noise, F.lit(2), 256).cast("string"), (_number(noise, F.lit(3), 254) + 1).cast("string"))
    digits = F.concat(F.substr(F.lit("23456789"), _number(noise, F.lit(20), 8) + 1, F.lit(1)), F.substr(_alike(norm, noise), F.lit(2), F.length(norm)))
    card = _valid_card(F.concat(F.left(norm, F.lit(1)), F.substr(_alike(norm, noise), F.lit(2), F.length(norm))), norm)
    iban = _valid_iban(F.concat(F.left(norm, F.lit(2)), F.substr(_alike(norm, noise), F.lit(3), F.length(norm))), norm)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind.isin("given", "family"), _name(kind, F.col("gender"), F.col("script"), noise, turn // WIDER)).otherwise(digits)
    )


def _typed(found: DataFrame) -> DataFrame:
    """found (entity, size) with kind and an array of units (part, kind, gender, script, norm)."""
    entity = F.col("entity")
    kind = reduce(lambda done, k: done.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), k), list(PATTERNS)[1:], F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), "email")).otherwise("person")
    digits = F.regexp_replace(entity, r"\D", "")
    title = F.regexp_extract(entity, rf"^({_titles})\.? ", 1)
    words = F.split(F.regexp_replace(entity, rf"^(?:{_titles})\.? ", ""), " ")
    by_title = reduce(lambda done, g: done.when(title.isin(*TITLES[g]), g), ("f",), F.when(title.isin(*TITLES["m"]), "m"))
    first = F.element_at(words, 1)
    gender = F.coalesce(by_title, F.when(first.isin(*GIVEN["m"]), "m").when(first.isin(*GIVEN["f"]), "f"), F.lit("n"))

    def unit(w, i):
        script = F.when(w.rlike(SCRIPTS[0][1]), SCRIPTS[0][0]).when(w.rlike(SCRIPTS[1][1]), SCRIPTS[1][0]).otherwise("latin")
        return F.struct(w.alias("part"), F.when((i == 0) & (F.size(words) > 1), "given").otherwise("family").alias("kind"), F.when((i == 0) & (F.size(words) > 1), gender).otherwise("n").alias("gender"), script.alias("script"), F.initcap(F.lower(w)).alias("norm"))

    norm = F.when(kind == "email", F.lower(entity)).when(kind == "ip", entity).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "phone", F.right(digits, F.lit(10))).otherwise(digits)
    whole = F.array(F.struct(entity.alias("part"), kind.alias("kind"), F.lit("n").alias("gender"), F.lit("latin").alias("script"), norm.alias("norm")))
    return found.select("entity", "size", kind.alias("kind"), F.when(kind == "person", F.transform(words, unit)).otherwise(whole).alias("units"))


def _drawn(units: DataFrame, key: str) -> DataFrame:
    """(kind, gender, norm, surrogate): all different within a kind and none a real norm of that kind."""
    real = units.select("kind", F.col("norm").alias("cand")).distinct()
    left, done = units, None
    for turn in range(LAST):
        drawn = left.select("kind", "gender", "script", "norm", _candidate(key, turn).alias("cand"))
        taken = real if done is None else real.union(done.select("kind", F.col("surrogate")))
        first = drawn.groupBy("kind", "cand").agg(F.min(F.struct("norm", "gender")).alias("first"))
        free = first.join(taken, ["kind", "cand"], "left_anti").withColumnRenamed("cand", "surrogate")
        won = free.select("kind", F.col("first.norm").alias("norm"), F.col("first.gender").alias("gender"), "surrogate")
        done = saved(won if done is None else done.union(won))
        left = saved(left.join(done.select("kind", "norm", "gender"), ["kind", "norm", "gender"], "left_anti"))
        if left.isEmpty():
            return done
    raise ValueError(f"after {LAST} turns some entities have no surrogate of their own: their type has too few values")


def _rendered(part: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the layout of the entity: separators, a leading country code of up to three digits, and case are kept."""
    chars = F.split(part, "")
    behind = lambda i: F.length(F.regexp_replace(F.substr(part, i + 1, F.length(part)), r"[^0-9A-Z]", ""))
    # a long phone number: the digits between its country code and the last ten
    ahead = F.length(F.regexp_replace(part, r"[^0-9]", "")) - 3
    noise = _alike(F.lit("0" * 15), F.sha2(surrogate, 512))

    def laid(c, i):
        left, size = behind(i), F.length(surrogate)
        return F.when(c.rlike("^[0-9A-Z]$") & (left <= size), F.substr(surrogate, size - left + 1, F.lit(1))).when(c.rlike("^[0-9]$") & (left <= ahead), F.substr(noise, left - size, F.lit(1))).otherwise(c)

    numbered = F.array_join(F.transform(chars, laid), "")
    cased = F.when((part == F.upper(part)) & (F.length(part) > 1), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), numbered).when(kind.isin("given", "family"), cased).otherwise(surrogate)


def replace_entities(docs: DataFrame, key: str = "change-me", told_bytes: int = 16_000_000) -> DataFrame:
    """docs with `text` rewritten and n_entities; all other columns pass through (one named n_entities is replaced).

    n_entities counts what the patterns find.  In a text that names a person, the
    surname alone is replaced too wherever it stands as a word.  A null text stays
    null and has no entities; so has an empty one.  Rows that repeat are rewritten
    alike.  An empty table gives no rows.  The same key gives the same surrogates
    for the same table.

    Texts are searched once, where they lie; entities are counted by task before
    they move, and one that very many rows hold is dealt over many tasks.  What
    goes back to the rows meets them by broadcast where it takes told_bytes at
    most, which is counted first, and by shuffle beyond.
    """
    docs = docs.drop("n_entities").withColumn("text", F.col("text").cast("string"))
    text = F.col("text")
    row = [F.col("doc_id").alias("__plumb_doc"), F.xxhash64("text").alias("__plumb_row")]
    held = saved(docs.where(holds_some(text)).select(*row, F.array_distinct(entities(text)).alias("__plumb_found")))
    per_row = held.select("__plumb_doc", "__plumb_row", F.explode("__plumb_found").alias("entity"))
    typed = saved(_typed(per_row.groupBy("entity").agg(F.count("*").alias("size"))))
    parts = typed.select("entity", F.posexplode("units").alias("pos", "unit")).select("entity", "pos", "unit.*")
    drawn = _drawn(parts.groupBy("kind", "norm", "gender").agg(F.min("script").alias("script")), key)
    rendered = parts.join(drawn, ["kind", "norm", "gender"]).select("entity", "pos", "kind", "part", _rendered(F.col("part"), F.col("kind"), F.col("surrogate")).alias("new"))
    new = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), " ")
    families = F.collect_list(F.when(F.col("kind") == "family", F.struct("part", "new")))
    whole = rendered.groupBy("entity").agg(new.alias("new"), families.alias("families"))
    whole = saved(whole.join(typed.select("entity", "size"), "entity").select("entity", "size", F.concat(F.regexp_extract("entity", rf"^((?:{_titles})\.? )", 1), F.col("new")).alias("new"), "families"))
    total = whole.agg(F.sum("size")).first()[0] or 0
    met = meeting(per_row, whole, ["entity"], total, F.xxhash64("__plumb_doc", "__plumb_row"))
    maps = saved(met.groupBy("__plumb_doc", "__plumb_row").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("entity", "new")))).alias("__plumb_map"), F.array_distinct(F.flatten(F.collect_list("families"))).alias("__plumb_names")))
    weight = maps.agg(F.sum(F.length(F.to_json("__plumb_map")) + F.length(F.to_json("__plumb_names")) + 64)).first()[0] or 0
    both = docs.withColumn("__plumb_hash", row[1]).join(F.broadcast(maps) if weight <= told_bytes else maps, F.col("doc_id").eqNullSafe(F.col("__plumb_doc")) & (F.col("__plumb_hash") == F.col("__plumb_row")), "left")
    named = lambda gap: F.aggregate("__plumb_names", gap, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])"), n["part"], F.lit(r"(?![\p{L}\p{N}'’-])")), n["new"]))
    gaps = F.transform(F.split(text, ANY, -1), lambda gap: F.when(F.size("__plumb_names") > 0, named(gap)).otherwise(gap))
    rewritten = bound(gaps, lambda g: F.concat(F.element_at(g, 1), F.array_join(F.transform(entities(text), lambda e, i: F.concat(F.element_at("__plumb_map", e), F.element_at(g, i + 2))), "")))
    some = F.col("__plumb_map").isNotNull()
    return both.select(
        *[F.when(some, rewritten).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(some, F.size(entities(text))).otherwise(0).cast("long").alias("n_entities"),
    )
