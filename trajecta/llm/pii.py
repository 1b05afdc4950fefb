"""Personal data: detection, and keyed surrogates that keep type, format, script and gender.

An entity is first brought to one form (digits alone, no blanks, lower case), so that all its spellings share a
surrogate; the moved form is then laid into the spelling at hand. Digits and letters are moved by a keyed permutation
of all strings of their shape without a fixed point: a Feistel network takes a string to its place on a secret ring of
them, and the next string on the ring is its surrogate. So two entities of one shape never share a surrogate, none
stays what it is, and an entity has the same surrogate in every document and on every executor, without any exchange.
What a shape must hold (a reserved prefix, a kind of number) is kept by walking on until it holds again; check digits
and an address's range are set apart before. Names move on keyed rings of the lists of their gender and script, and
names out of the lists to unlisted ones of their shape. The collision check reads every replaced entity.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, saved

#: Where no key is given: a random one that is kept nowhere, so its surrogates cannot be reversed, nor met again in another run.
KEY = os.environ.get("TRAJECTA_PII_KEY", "").encode() or os.urandom(32)


def configured_key(spark: SparkSession) -> bytes:
    """The secret of spark.trajecta.pii.key, of the driver's TRAJECTA_PII_KEY, or else a random one of this run."""
    return spark.conf.get("spark.trajecta.pii.key", "").encode() or KEY

#: Given names by gender and script.
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carmen Charlotte Clara Elena Emily Emma Eva Hannah Isabel Julia Karen Laura Linda Lucia Maria Marie Martha Mary Nancy Olivia Patricia Sarah Sophie Susan".split(),
    ("m", "latin"): "Andrew Anthony Carlos Charles Daniel David Edward Frank George Hans Henry James Jean John Joseph Juan Karl Kevin Louis Mark Michael Paul Peter Pierre Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Надежда Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Владимир Дмитрий Иван Николай Сергей".split(),
}
#: Family names by script.
FAMILIES = {
    "latin": "Anderson Bernard Brown Clark Davis Dubois Fischer Garcia Gonzalez Harris Jackson Johnson Jones Klein Lewis Lopez Martin Martinez Meyer Miller Moore Moreau Müller Schmidt Schneider Smith Taylor Walker Weber Wilson".split(),
    "cyrillic": "Волков Иванов Козлов Кузнецов Лебедев Морозов Новиков Петров Попов Смирнов Соколов".split(),
}
#: The feminine forms, in the order of the masculine ones.
FAMILIES["cyrillic feminine"] = [f"{n}а" for n in FAMILIES["cyrillic"]]
_GIVEN = {n: k for k, names in NAMES.items() for n in names}
_FAMILY = {n: k for k, names in FAMILIES.items() for n in names}


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


#: Forms of address, which stay, and labels that a name follows.
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Señor Señora Don Doña Monsieur Madame Mme Mlle господин госпожа г-н г-жа".split()
LABELS = "name contact author signed patient customer Name Contact Author Signed Patient Customer имя Имя".split()
#: A capitalised word by script.
_CAP = {"latin": r"(?:[OD]['’])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?", "cyrillic": "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"}
#: Words that begin a sentence before a family name that is a word as well, as in "The Miller".
STARTS = "The A An And But Or In On At By For From Of To With This That These Those As If When Der Die Das Und Ein Eine Le La Les Un Une Et El Los Las Una Y Но Это В На И".split()
_WORD = "|".join(_CAP.values())
_INITIAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]\."


def _given_then_family(script: str) -> str:
    given = _any(n for n, (_, of) in _GIVEN.items() if of == script)
    family = _any(n for n, of in _FAMILY.items() if of.split()[0] == script)
    return rf"\b(?:(?:{given}) (?:{_INITIAL} )?(?:{_CAP[script]})|(?!(?:{_any([*STARTS, *TITLES])})\b)(?:{_CAP[script]}) (?:{_INITIAL} )?(?:{family}))(?!\w)"


#: What is detected, in order of precedence.
PATTERNS = [
    ("email", r"(?<![\w.+\u0300-\u036f-])\w[\w.+\u0300-\u036f-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"(?i:token[\"']?[ \t]*[=:][ \t]*[\"']?(?P<token>(?![\w.+-]*@)[a-z0-9_/+=.~-]{15,}[a-z0-9_/+=-])|(?:password|passwd|pwd|api[_-]?key|secret(?:[_-]?key)?|access[_-]?key)[\"']?(?:=|:[ \t]|[ \t]=)[ \t]*[\"']?(?P<word>[^\s\"',;]{8,}))|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?![\d]|\.\d)"),
    ("ipv6", r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    ("phone", r"(?<![\w.+-])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{2,4}(?:[ .-]?\d{2,4})?(?![\w-]|\.\d)|(?<![\w+])\+\d{8,15}(?!\w)"),
    ("name", "|".join([*map(_given_then_family, _CAP), rf"\b(?:{_INITIAL} ?){{1,2}}(?:{_any(_FAMILY)})\b", rf"\b(?:(?:{_any(TITLES)})\.?|(?:{_any(LABELS)}):) (?P<person>(?:(?:{_INITIAL}|{_WORD}) ){{0,2}}(?:{_WORD})(?!\w))"])),
]
#: Country codes of one and of two digits; all others have three.
CODES = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
#: The same for texts without a known given or family name, a title or a label, which are nearly all.
FIND_NAMELESS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS if kind != "name"))
_NAME_MARKS = tuple(dict.fromkeys([*_GIVEN, *_FAMILY, *(f"{t} " for t in TITLES), *(f"{t}. " for t in TITLES), *(f"{x}: " for x in LABELS)]))
#: What a text must hold for any pattern but the names' to match.
MAYBE = re.compile(r"[@\d=:]|sk-|AKIA|gh[pousr]_")

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PLACE = {c: (letters, i) for letters in _CLASSES for i, c in enumerate(letters)}
#: Hexadecimal digits of one case are one class where a secret holds nothing else.
_HEX, _HEX_UPPER = ({c: (letters, i) for i, c in enumerate(letters)} for letters in ("0123456789abcdef", "0123456789ABCDEF"))
#: Prefixes that tell a secret's type, and stay.
_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")


@lru_cache(10_000)
def _alike(c: str) -> str:
    """The letters (or digits) of the kind of ``c`` among the 32 code points around it, in lower case where it is: its script and look stay."""
    start, kind = ord(c) & ~31, unicodedata.category(c)
    return "".join(x for x in map(chr, range(start, start + 32)) if unicodedata.category(x) == kind and (x.lower() == x) == (c.lower() == c))


def _places(text: str) -> dict:
    """_PLACE, and the places of the text's other letters and digits."""
    others = {c: (_alike(c), _alike(c).index(c)) for c in set(text) if not c.isascii() and unicodedata.category(c)[0] in "LN"}
    return _PLACE | others if others else _PLACE


def _mixed(b: int, mask: int, key: bytes, tweak: str) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{b}".encode(), hashlib.sha256), "big") & mask


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, or its inverse: ten Feistel rounds over the least even number of bits, walked until in range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in reversed(range(10)) if back else range(10):
            if back:
                a, b = b ^ _mixed(a, mask, key, f"{tweak}|{size}|{r}"), a
            else:
                a, b = b, a ^ _mixed(b, mask, key, f"{tweak}|{size}|{r}")
        value = (a << half) | b
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, tweak: str) -> int:
    """The next number on a keyed ring of all 0 .. size - 1: a permutation of one cycle, so that none stays in place."""
    return permuted((permuted(value, size, key, tweak) + 1) % size, size, key, tweak, back=True) if size > 1 else value


def reshaped(text: str, key: bytes, tweak: str, holds: Callable[[str], bool] = lambda _: True, place: dict = _PLACE) -> str:
    """Digits go to digits and letters to letters of their case, all else stays; walked along the ring until ``holds``.

    Distinct texts of one shape that hold get distinct results, and none its own, unless it alone holds.
    """
    places = [(i, *place[c]) for i, c in enumerate(text) if c in place]
    size, value = 1, 0
    for _, letters, at in places:
        size, value = size * len(letters), value * len(letters) + at
    shape = "".join(place[c][0][-1] if c in place else c for c in text)
    start, out = value, list(text)
    while size > 1:
        rest = value = moved(value, size, key, f"{tweak}|{shape}")
        for i, letters, _ in reversed(places):
            rest, at = divmod(rest, len(letters))
            out[i] = letters[at]
        if value == start or holds("".join(out)):
            break
    return "".join(out)


def _next(names: list[str], name: str, key: bytes, tweak: str) -> str:
    """The name that follows on a keyed ring of all."""
    return names[moved(names.index(name), len(names), key, tweak)]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _check_digit(digits: str) -> int:
    """The digit that makes a number pass Luhn's test behind ``digits``."""
    return next(d for d in range(10) if luhn(f"{digits}{d}"))


def _laid(found: str, characters: str) -> str:
    """``characters`` in the places of the letters and digits of ``found``."""
    given = iter(characters)
    return "".join(next(given) if c.isalnum() else c for c in found)


def _card(digits: str, key: bytes) -> str:
    """The issuer's digit stays, and how far the last digit is from the one that passes the test."""
    body = digits[0] + reshaped(digits[1:-1], key, f"card {digits[0]}")
    return body + str((_check_digit(body) + int(digits[-1]) - _check_digit(digits[:-1])) % 10)


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _iban(text: str, key: bytes) -> str:
    """The country stays, and how far the check digits are from the valid ones."""
    country, check, rest = text[:2], int(text[2:4]), text[4:]
    made = reshaped(rest, key, f"iban {country}")
    return f"{country}{(_iban_check(country, made) + check - _iban_check(country, rest)) % 100:02d}{made}"


def _phone(found: str, key: bytes) -> str:
    """All digits of a number: a country code stays, and whether the next digit is 0, 1 or another."""
    digits = re.sub(r"\D", "", found)
    code = 0
    if found.startswith(("+", "00")):
        code = 2 if found.startswith("00") else 0
        code += next((n for n, codes in CODES.items() if digits[code : code + n] in codes), 3)
    rest = digits[code:]
    kind = lambda x: min(int(x[0]), 2)
    return digits[:code] + (reshaped(rest, key, f"phone {digits[:code].removeprefix('00')}", lambda x: kind(x) == kind(rest)) if rest else "")


#: Bits of an address that stay, by the range that it is in; public addresses move among themselves.
_RANGES = [(10 << 24, 8), (127 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (169 << 24 | 254 << 16, 16), (0, 8), (224 << 24, 3)]


def _range(value: int) -> int | None:
    return next((bits for start, bits in _RANGES if value >> (32 - bits) == start >> (32 - bits)), None)


def _ipv4(found: str, key: bytes) -> str:
    parts = found.split(".")
    value = int.from_bytes(bytes(map(int, parts)), "big")
    if bits := _range(value):
        low = 32 - bits
        value = value >> low << low | moved(value & ((1 << low) - 1), 1 << low, key, f"ipv4 {value >> low}")
    else:
        value = moved(value, 1 << 32, key, "ipv4")
        while _range(value):
            value = moved(value, 1 << 32, key, "ipv4")
    # leading zeros stay as wide as they were
    return ".".join(str(b).zfill(len(p) if p[0] == "0" else 1) for b, p in zip(value.to_bytes(4, "big"), parts))


#: Vowels and consonants by script, and endings of family names that tell the gender, which stay.
_SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")
_SPOKEN = {c: (letters, i) for sounds in _SOUNDS for letters in (sounds, sounds.upper()) for i, c in enumerate(letters)}
_ENDINGS = re.compile("(?:ов|ев|ин|ова|ева|ина|ский|ская|енко)$")


def _name_part(word: str, key: bytes) -> str:
    """A listed name goes to one of its list, an initial to an initial, and an unlisted name to an unlisted one of its shape."""
    if word in _GIVEN:
        return _next(NAMES[_GIVEN[word]], word, key, "".join(_GIVEN[word]))
    if word in _FAMILY:
        return _next(FAMILIES[_FAMILY[word]], word, key, _FAMILY[word].split()[0])
    end = m[0] if (m := _ENDINGS.search(word, 1)) else ""
    unlisted = lambda x: x + end not in _GIVEN and x + end not in _FAMILY
    stem = word.removesuffix(end)
    return reshaped(stem, key, f"name {end}", unlisted, {c: p for c, p in _places(stem).items() if c not in _PLACE} | _SPOKEN) + end


def surrogate(kind: str, found: str, key: bytes = KEY) -> str:
    """The replacement of a detected entity; the same for the same entity everywhere, however it is written."""
    if kind == "email":
        local, _, domain = found.lower().rpartition("@")
        host, _, end = domain.rpartition(".")
        return f"{reshaped(local, key, 'local', place=_places(local))}@{reshaped(host, key, 'host')}.{end}"
    if kind == "card":
        return _laid(found, _card(re.sub(r"\D", "", found), key))
    if kind == "phone":
        return _laid(found, _phone(found, key))
    if kind == "ipv4":
        return _ipv4(found, key)
    if kind == "ssn":
        valid = _ssn(found)
        return reshaped(found, key, "ssn" if valid else "no ssn", lambda x: _ssn(x) == valid)
    if kind == "name":
        return re.sub(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", lambda m: _name_part(m[0], key), found)
    if kind == "iban":
        return _laid(found, _iban(found.replace(" ", ""), key))
    if kind == "ipv6":
        groups = found.lower().split(":")
        made = reshaped("".join(g.zfill(4) for g in groups[1:]), key, f"ipv6 {groups[0].zfill(4)}", place=_HEX)  # the first group tells the address's kind
        return ":".join([groups[0], *(made[i : i + 4] for i in range(0, len(made), 4))])
    if kind == "secret":
        lead = next((p for p in _PREFIXES if found.startswith(p)), "")
        rest = found[len(lead) :]
        place = _secret_place(rest)
        return lead + reshaped(rest, key, f"secret {lead}", lambda x: _secret_place(x) is place, place)  # each class is closed, so results of two never meet
    return reshaped(found, key, kind)


def _secret_place(text: str) -> dict:
    return next((p for p in (_HEX, _HEX_UPPER) if p.keys() >= set(text)), _PLACE)


def _ssn(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


@lru_cache(50_000)
def _kept(kind: str, found: str, key: bytes) -> str:
    return surrogate(kind, found, key)


def _is_one(kind: str, found: str) -> bool:
    """Whether a match of a kind's pattern is one: cards pass Luhn's test; a row of years is no phone number."""
    if kind == "card":
        return luhn(re.sub(r"\D", "", found))
    if kind == "phone":
        groups = re.findall(r"\d+", found)
        return len("".join(groups)) >= 7 and not ("+" not in found and all(len(g) == 4 and g[:2] in ("19", "20") for g in groups))
    return True


def _matches(text: str, find: re.Pattern) -> Iterator[tuple[str, int, str]]:
    """kind, start and entity; what is no entity after all is looked at again behind its first character group."""
    at = 0
    while m := find.search(text, at):
        kind = m.lastgroup if m.lastgroup not in ("token", "word", "person") else None
        part = next((g for g in ("token", "word", "person") if g in m.groupdict() and m[g]), None)
        kind = kind or ("name" if part == "person" else "secret")
        start, found = (m.start(part), m[part]) if part else (m.start(), m[0])
        if _is_one(kind, found):
            yield kind, start, found
            at = m.end()
        else:
            at = m.end() if kind == "card" else m.start() + len(re.match(r"\D*\d+", found)[0])


def masked(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[str, int, int, str, str]]]:
    """A text with surrogates, and what was found: kind, start, length (in characters of the given text), entity, surrogate.

    Where a full name stands, its given and family name alone are replaced alike elsewhere in the text. An entity whose
    value happens to be another's surrogate is itself replaced wherever it stands, so the two stay apart in every text.
    """
    if not text:
        return text, []
    named = any(f in text for f in _NAME_MARKS)
    if not named and not MAYBE.search(text):
        return text, []
    matches = list(_matches(text, FIND if named else FIND_NAMELESS))
    if words := {w for kind, _, found in matches if kind == "name" for w in re.findall(_WORD, found)}:
        taken = [(start, start + len(found)) for _, start, found in matches]
        alone = re.finditer(rf"(?<!\w)(?:{_any(words)})(?!\w)", text)
        matches = sorted([*matches, *(("name", m.start(), m[0]) for m in alone if not any(a < m.end() and m.start() < b for a, b in taken))], key=lambda x: x[1])
    out, found, at = [], [], 0
    for kind, start, entity in matches:
        made = _kept(kind, entity, key)
        found.append((kind, start, len(entity), entity, made))
        out += [text[at:start], made]
        at = start + len(entity)
    return "".join([*out, text[at:]]) if found else text, found


def canonical(kind: str, entity: str) -> str:
    """The one form of all spellings of an entity."""
    if kind in ("phone", "card"):
        digits = re.sub(r"\D", "", entity)
        return f"+{digits.removeprefix('00')}" if entity.startswith(("+", "00")) and kind == "phone" else digits
    if kind == "ipv4":
        return ".".join(str(int(p)) for p in entity.split("."))
    if kind == "ipv6":
        return ":".join(g.zfill(4) for g in entity.lower().split(":"))
    return entity.lower() if kind == "email" else entity.replace(" ", "") if kind == "iban" else entity


def surrogates(docs: DataFrame, key: bytes | None = None, text: str = "text", told: bool = False) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in the text, and pii: an array of structs kind, start, length.

    Null and empty texts stay, with an empty array; repeated rows are masked alike; other columns stay, except
    that a column named pii gives way. The entities themselves are not returned; with ``told`` the structs also hold
    keyed digests of entity and surrogate (in their one form), which the collision check reads. Without a ``key`` that of
    the configuration is taken.
    """
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    secret = configured_key(docs.sparkSession) if key is None else key
    columns = [c for c in docs.columns if c != "pii"]
    at = columns.index(text)
    digests = [StructField("entity", LongType()), StructField("made", LongType())] if told else []
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType()), *digests])
    schema = StructType([*docs.select(*columns).schema.fields, StructField("pii", ArrayType(span))])

    def digest(kind: str, value: str) -> int:
        return int.from_bytes(hmac.digest(secret, f"{kind}|{canonical(kind, value)}".encode("utf-8", "replace"), hashlib.sha256)[:8], "big", signed=True)

    def rows(given: Iterator[tuple]):
        for row in given:
            value, found = masked(row[at], secret)
            yield (*row[:at], value, *row[at + 1 :], [{"kind": k, "start": s, "length": n} | ({"entity": digest(k, e), "made": digest(k, m)} if told else {}) for k, s, n, e, m in found])

    return arrow_map(docs, columns, schema, rows, flush=2_000)


def entities(docs: DataFrame, key: bytes | None = None, text: str = "text") -> DataFrame:
    """doc_id, kind, entity_sha256 and surrogate (in its one form) of every detected entity: what the collision check reads."""
    secret = configured_key(docs.sparkSession) if key is None else key

    def rows(given: Iterator[tuple]):
        for doc_id, value in given:
            for kind, _, _, entity, made in masked(value, secret)[1]:
                yield doc_id, kind, hashlib.sha256(canonical(kind, entity).encode("utf-8", "replace")).hexdigest(), canonical(kind, made)

    return arrow_map(docs, ["doc_id", text], "doc_id long, kind string, entity_sha256 string, surrogate string", rows)


def collisions(found: DataFrame, entity: str = "entity_sha256", made: str = "surrogate") -> DataFrame:
    """Surrogates that stand for more than one entity, or entities with more than one surrogate: none, by construction."""
    pairs = found.select("kind", F.col(entity).cast("string").alias("e"), F.col(made).cast("string").alias("m")).distinct()
    split = lambda c: pairs.groupBy("kind", F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    return split("m").union(split("e"))


def checked(masked_docs: DataFrame) -> DataFrame:
    """Masked documents (told, written) after the collision check; raises ValueError where surrogates collide."""
    found = masked_docs.select(F.explode("pii").alias("p")).select("p.*")
    if not collisions(found, "entity", "made").isEmpty():
        raise ValueError("surrogates collide; give another key")
    return masked_docs


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checked(saved(surrogates(documents(spark, sf_dir).select("doc_id", "text"), told=True)))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), F.expr("array_sort(array_distinct(transform(pii, p -> p.kind)))").alias("kinds"))
