"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities get replacements of their own type and format. Digits and letters
go through a keyed Feistel permutation over all strings of the same shape, so two
entities never get one surrogate, one entity gets the same one everywhere (whatever
its case or punctuation), and nothing needs a table. Cards keep their first digit
and stay valid or invalid, addresses keep their octets in range and public or
private, mail addresses keep their domains together, names keep the gender and
script of their title and letters, and a full name, its first or its last word is
replaced alike where it stands without a title in that text. A common given name before
a capitalised word is a name without any title. After the replacement, a count over all distinct entities
checks that no two of a type share a surrogate and that none stayed itself; those
that do are permuted again under another tweak until none is left. It is an error if
further tweaks leave as many.

Defined results: null texts stay null and empty ones empty; texts without entities
are returned as they were, byte for byte; whole texts are searched; repeated rows
get the same result; empty tables give none; extra columns stay.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import itertools
import re
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import per_batch, written

#: Rounds of the permutation, and of new tweaks for entities that collide; further ones only while they help.
ROUNDS, TWEAKS = 6, 4

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_SIGNS, _TOKEN_SIGNS = "!#$%&()*+-./:<=>?@[\\]^_`{|}~", "_-/+"
_HEX, _BASE36 = _DIGITS + "abcdef", _DIGITS + _LOWER.upper()

#: Titles by gender, and given names by gender and script. Fixed values.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("m", "latin"): tuple("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Paul Joshua Kenneth Kevin Brian George Edward Peter Martin Carlos Miguel Louis Hans Karl Juan Pedro Pablo Diego Antonio Javier Pierre Jacques Philippe Henri Stefan Wolfgang Klaus Dieter Giovanni Marco Giuseppe Jan Piotr Lars Erik".split()),
    ("f", "latin"): tuple("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Michelle Anna Maria Laura Julia Clara Sophie Carmen Lucia Marie Emma Helen Alice Ana Isabel Elena Rosa Pilar Camille Claire Isabelle Juliette Ursula Petra Heike Sabine Monika Ingrid Giulia Francesca Chiara Agnieszka Katarzyna Astrid Sigrid".split()),
    ("n", "latin"): ("Alex", "Robin", "Kim", "Sasha", "Noel", "Dominique", "Andrea", "Jordan", "Taylor", "Morgan"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Павел", "Сергей", "Андрей", "Николай"),
    ("f", "cyrillic"): ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава"),
}
#: Letters that replace one another in names: vowels and consonants of each script.
_NAME_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñçß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ãåæðõøýþÿ", "ъь")

#: Words that stand small inside a name. Fixed values.
PARTICLES = frozenset("de la las los del da das dos di della van von der den du le el al bin ibn zu ter ten y e".split())


def _letters(*categories: str) -> str:
    """The characters of some categories of Unicode, as ranges of a pattern's class."""
    out, start = [], None
    for c in range(0x80, sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)) in categories
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_TITLE_CAPITALS, _TITLE_SMALL = _TITLE.upper(), r"mrs?|(?:ms|dr)(?=\.)"
_U, _L, _O, _M = "A-Z" + _letters("Lu", "Lt"), "a-z" + _letters("Ll"), _letters("Lo"), _letters("Mn", "Mc")
#: A capitalised word of any script with cases (O'Brien, McCoy, Jean-Luc), or a word of one without.
_CASED = rf"[{_U}](?:['’]?[{_U}]?[{_L}{_M}]++)++(?:-[{_U}](?:['’]?[{_U}]?[{_L}{_M}]++)++)*+"
_WORD = rf"(?:{_CASED}|[\u3400-\u9fff]{{2,3}}|(?![\u3400-\u9fff])[{_O}][{_O}{_M}]++)"
_INNER = rf"(?:[{_U}]\. ?|(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )"
_NAME = rf"{_INNER}*{_WORD}(?: {_INNER}*{_WORD})*"
_CAPITALS = rf"[{_U}](?:['’-]?[{_U}]++)++(?: [{_U}](?:['’-]?[{_U}]++)++)*"
_GIVEN = {n: g for (g, _), ns in GIVEN.items() if g != "n" for n in ns}
_H = "[0-9A-Fa-f]{1,4}"
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,})"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?i:\b(?:token|secret|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<token>[A-Za-z0-9_\-/+]{12,})"
    r"|(?i:\b(?:password|passwd|pwd)\b\s*[=:]\s*[\"']?)(?P<password>[^\s\"',;]{4,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?![\w]|\.\d)"
    rf"|(?<![\w:.])(?P<ip6>(?:{_H}:){{7}}{_H}|{_H}(?::{_H}){{0,5}}::(?:{_H}(?::{_H}){{0,5}})?)(?![\w:])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|(?<![.-])0\d{1,4}[ /-]\d{5,8}(?![ -]?\d))(?!\w)"
    r"|(?<![\w.])(?P<card>[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{4}|[3-6]\d{12,18})(?!\w)"
    rf"|\b(?P<title>{_TITLE})\.? (?P<name>{_NAME})"
    rf"|\b(?P<capital_title>{_TITLE_CAPITALS})\.? (?P<capital_name>{_CAPITALS})\b"
    rf"|\b(?P<small_title>{_TITLE_SMALL})\.? (?P<small_name>[{_L}]{{2,}}+)"
    rf"|\b(?=[{_U}])(?P<full_name>(?:{'|'.join(sorted(_GIVEN, key=len, reverse=True))}) {_INNER}*{_CASED})"
)
_GENDER = {form: g for g, ts in TITLES.items() for t in ts for form in (t, t.upper(), t.lower())}
_TITLED = (*(t + x for t in _GENDER for x in (" ", ". ")), *(n + " " for n in _GIVEN))
TYPES = ("email", "key", "token", "password", "iban", "ip", "ssn", "phone", "card", "name")

_HINT = re.compile(r"[0-9@]|::|AKIA|(?i:token|secret|api[_-]?key|access[_-]?key|passw|pwd)")


def permute(key: bytes, tweak: str, values: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of all mixed-radix numbers with these radices (unbalanced Feistel)."""
    half = len(values) // 2
    if not values:
        return values
    sides, sizes = [], []
    for part in (slice(0, half), slice(half, None)):
        n, size = 0, 1
        for v, r in zip(values[part], radices[part], strict=True):
            n, size = n * r + v, size * r
        sides.append(n)
        sizes.append(size)
    for k in range(ROUNDS):
        other = sides[1 - k % 2]
        data = f"{tweak}|{k}|{len(values)}|{other}".encode()
        width = max(8, (sizes[k % 2].bit_length() + 71) // 8)
        noise = int.from_bytes(hashlib.shake_256(key + data).digest(width), "big")
        sides[k % 2] = (sides[k % 2] + noise) % sizes[k % 2]
    out = []
    for n, part in zip(sides, (radices[:half], radices[half:]), strict=True):
        digits = []
        for r in reversed(part):
            n, d = divmod(n, r)
            digits.append(d)
        out += digits[::-1]
    return out


def permute_text(key: bytes, tweak: str, text: str, alphabets: list[str | None]) -> str:
    """``permute`` over the characters that have an alphabet; the shape is part of the tweak."""
    at = [i for i, a in enumerate(alphabets) if a]
    shape = "".join(text[i] if a is None else f"<{len(a)}>" for i, a in enumerate(alphabets))
    values = permute(key, f"{tweak}|{shape}", [alphabets[i].index(text[i]) for i in at], [len(alphabets[i]) for i in at])
    out = list(text)
    for i, v in zip(at, values, strict=True):
        out[i] = alphabets[i][v]
    return "".join(out)


def _classes(text: str, classes: tuple[str, ...]) -> list[str | None]:
    return [next((a for a in classes if c in a), None) for c in text]


def _any_class(c: str) -> str:
    """Characters that may replace any one of a password: of its kind in ASCII, else of its 64 code points."""
    for a in (_LOWER, _LOWER.upper(), _DIGITS, _SIGNS):
        if c in a:
            return a
    first = ord(c) & ~63
    every = map(chr, range(first, first + 64) if first >= 128 else (*range(32), 127))
    return "".join(x for x in every if not x.isspace())


def _walk(step: Callable[[str], str], text: str, same: Callable[[str], object]) -> str:
    """Permute until the result is of the kind that ``same`` tells: a permutation of each kind."""
    kind, now = same(text), step(text)
    while same(now) != kind:
        now = step(now)
    return now


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _ip_kind(octets: str) -> str:
    a, b, *_ = map(int, octets.split("."))
    if a in (0, 127) or a >= 224:
        return f"special {a}"
    return "private" if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else "link" if (a, b) == (169, 254) else "public"


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind == "email":
        return text.lower()
    if kind in ("phone", "card"):
        return ("+" if text.startswith("+") else "") + "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip" and ":" in text:
        return ipaddress.ip_address(text).exploded
    if kind == "name":
        return " ".join(w if w in PARTICLES else "-".join(p.capitalize() for p in w.split("-")) for w in text.split(" "))
    return text


def _groups(address: str) -> list[bool]:
    """Which groups of an IPv6 address are not zero; they are what its surrogate keeps."""
    return [bool(int(g, 16)) for g in address.split(":")]


def surrogate(key: bytes, kind: str, entity: str, tweak: int = 0) -> str:
    """The replacement of a canonical entity, canonical too. Names come as ``gender:name``."""
    t = f"{kind}{tweak or ''}"
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        name, _, tld = domain.rpartition(".")
        domain = permute_text(key, t + "domain", name, _classes(name, (_LOWER, _DIGITS))) + "." + tld
        return permute_text(key, t + entity.rpartition("@")[2], local, _classes(local, (_LOWER, _DIGITS))) + "@" + domain
    if kind in ("phone", "ssn"):
        # a country's code stays: digits after the plus, but for the last ten
        fixed = len(entity) - 10 if entity.startswith("+") and len(entity) > 11 else 2 if entity.startswith("+") else 0
        step = lambda x: permute_text(key, t, x, [_DIGITS if c.isdigit() and i >= fixed else None for i, c in enumerate(x)])
        # a national number keeps its leading zero, as others stay without one
        return _walk(step, entity, lambda x: kind == "phone" and x.startswith("0"))
    if kind == "card":
        step = lambda x: permute_text(key, t, x, [None] + [_DIGITS] * (len(x) - 1))
        return _walk(step, entity, luhn)
    if kind == "ip" and ":" in entity:
        free = [i for i, full in enumerate(_groups(entity)) if full and i]
        step = lambda x: permute_text(key, t, x, [_HEX if c != ":" and i // 5 in free else None for i, c in enumerate(x)])
        return _walk(step, entity, _groups)
    if kind == "ip":
        step = lambda x: ".".join(map(str, permute(key, t, [int(o) for o in x.split(".")], [256] * 4)))
        return _walk(step, entity, _ip_kind)
    if kind == "key":
        return entity[:4] + permute_text(key, t, entity[4:], [_BASE36] * 16)
    if kind == "iban":
        return entity[:2] + permute_text(key, t + entity[:2], entity[2:], _classes(entity[2:], (_DIGITS, _LOWER.upper())))
    if kind == "name":
        gender, _, name = entity.partition(":")
        parts = name.split(" ")
        if len(parts) > 1:
            pool = GIVEN[gender, "cyrillic" if "а" <= parts[0][-1] <= "ё" else "latin"]
            if parts[0] in pool:
                parts[0] = pool[permute(key, t + gender, [pool.index(parts[0])], [len(pool)])[0]]
                return f"{gender}:{parts[0]} " + " ".join(_name_part(key, t, p) for p in parts[1:])
        return f"{gender}:" + " ".join(_name_part(key, t, p) for p in parts)
    if re.fullmatch(r"[0-9a-f]+", entity):
        return permute_text(key, t, entity, [_HEX] * len(entity))
    if kind == "password":
        return permute_text(key, t, entity, [_any_class(c) for c in entity])
    letters = _classes(entity, (_LOWER, _LOWER.upper(), _DIGITS))
    return permute_text(key, t, entity, letters if any(letters) else [_TOKEN_SIGNS] * len(entity))


def _name_part(key: bytes, tweak: str, part: str) -> str:
    if "-" in part:
        return "-".join(_name_part(key, tweak, p) for p in part.split("-"))
    if part in PARTICLES:
        return part
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in part)
    return permute_text(key, tweak, low, [k or _same_letters(c) for c, k in zip(low, _classes(low, _NAME_CLASSES), strict=True)]).capitalize()


@functools.cache
def _same_letters(c: str) -> str | None:
    """For a letter of no class of its own, those of its kind among 64 code points."""
    kind, first = unicodedata.category(c), ord(c) & ~63
    known = "".join(_NAME_CLASSES)
    near = [x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and x not in known]
    near = [x for x in near if kind == "Lo" or kind == "Ll" and len(x.upper()) == 1 and x.upper().lower() == x]
    return "".join(near) if c in near else None


def laid_out(kind: str, text: str, new: str, entity: str = "") -> str:
    """A canonical surrogate in the format of a mention, which may be a part of a name."""
    if kind == "name":
        own, all_, words = canonical(kind, text).split(" "), entity.partition(":")[2].split(" "), new.partition(":")[2].split(" ")
        at = next((i for i in range(len(all_) - len(own) + 1) if all_[i : i + len(own)] == own), max(0, len(words) - len(own)))
        return " ".join(map(_cased, text.split(" "), words[at : at + len(own)]))
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(text, new, strict=True))
    if kind in ("phone", "card", "iban"):
        chars = iter(c for c in new if c.isalnum())
        return "".join(next(chars) if c.isalnum() else c for c in text)
    if kind == "ip" and ":" in new:
        full = all(len(g) == 4 for g in text.split(":"))
        out = new if full else ipaddress.ip_address(new).compressed if "::" in text else ":".join(f"{int(g, 16):x}" for g in new.split(":"))
        return out.upper() if text.isupper() else out
    return new


def _cased(own: str, new: str) -> str:
    if own.isupper() and len(own) > 1 or own.islower():
        return new.upper() if own.isupper() else new.lower()
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(own, new, strict=True)) if len(own) == len(new) else new


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical entity) of each mention."""
    if not _HINT.search(text) and not any(t in text for t in _TITLED):
        return []
    out, parts = [], {}
    for m in PATTERN.finditer(text):
        group = m.lastgroup
        kind = "name" if group.endswith("name") else "ip" if group == "ip6" else group
        start, end = m.span(group)
        own = m[group]
        if kind == "phone" and sum(c.isdigit() for c in own) < 7:
            continue
        if group == "ip6" and not _address(own):
            continue
        entity = canonical(kind, own)
        if kind == "name":
            gender = _GIVEN[own.split(" ")[0]] if group == "full_name" else _GENDER[m[group.replace("name", "title")]]
            words, entity = entity.split(" "), f"{gender}:{entity}"
            for part in (" ".join(words), words[-1], words[0]):
                if len(part) > 1 and "." not in part.split(" ")[-1] and part not in PARTICLES:
                    parts.setdefault(part, entity)
        out.append((start, end, kind, entity))
    if parts:
        spelt = {part: e for p, e in parts.items() for part in (p, _inner_capitals(text, p))}
        alone = re.compile(r"(?<![\w-])(?:" + "|".join(map(re.escape, sorted(spelt, key=len, reverse=True))) + r")(?![\w-])")
        taken = [(start, end) for start, end, _, _ in out]
        at = 0
        for m in alone.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or m.end() <= taken[at][0]:
                out.append((*m.span(), "name", spelt[m[0]]))
        out.sort()
    return out


def _inner_capitals(text: str, part: str) -> str:
    """How a text spells a name that has capitals inside its words, if it does."""
    if "'" not in part and "’" not in part and not part.startswith(("Mc", "Mac")):
        return part
    m = re.search(r"(?<!\w)" + re.escape(part) + r"(?!\w)", text, re.I)
    return m[0] if m and m[0][0].isupper() and not m[0].isupper() else part


def _address(text: str) -> bool:
    """Whether this is the IPv6 address of a host: three groups or more, a digit, and more than a leading group."""
    try:
        groups = _groups(ipaddress.ip_address(text).exploded)
    except ValueError:
        return False
    return any(groups[1:]) and text.count(":") > 2 and any(c.isdigit() for c in text)


class Replacer:
    """Replaces mentions in texts; remembers a bounded number of surrogates."""

    def __init__(self, key: bytes, kept: int = 50_000):
        self.key, self.kept, self.known = key, kept, {}

    def new(self, kind: str, entity: str, tweak: int) -> str:
        found = self.known.get((kind, entity, tweak))
        if found is None:
            if len(self.known) >= self.kept:
                self.known.clear()
            found = self.known[kind, entity, tweak] = surrogate(self.key, kind, entity, tweak)
        return found

    def __call__(self, text: str, tweaks: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
        parts, last, entities = [], 0, []
        for start, end, kind, entity in find(text):
            new = self.new(kind, entity, (tweaks or {}).get((kind, entity), 0))
            parts += [text[last:start], laid_out(kind, text[start:end], new, entity)]
            entities.append((kind, entity, new))
            last = end
        return ("".join([*parts, text[last:]]) if entities else text), entities


_ENTITIES = "array<struct<kind:string,entity:string,new:string>>"


def collisions(entities: DataFrame) -> DataFrame:
    """Of (kind, entity, new): entities whose surrogate another one of their kind has, too, or that kept themselves."""
    each = entities.select("kind", "entity", "new").distinct()
    shared = each.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("entity").alias("first"))
    return each.join(shared, ["kind", "new"]).filter("entity = new or n > 1 and entity != first").select("kind", "entity")


def replace(docs: DataFrame, key: str, text: str = "text", make_replacer: Callable[[bytes], Replacer] = Replacer) -> DataFrame:
    """``docs`` as ``_c0``, ``_c1``, ... in order, with mentions in ``text`` replaced, and ``_entities``.

    Columns go by number, so that no name of the input can clash.
    """
    secret, at = key.encode(), docs.columns.index(text)
    columns = [f"_c{k}" for k in range(len(docs.columns))]
    docs = docs.toDF(*columns)
    text = columns[at]
    schema = StructType([*docs.schema.fields, *_entity_schema(docs).fields])

    def run(rows: DataFrame, tweaked: bool) -> DataFrame:
        def make():
            replacer = make_replacer(secret)

            def many(*values):
                own, tweaks = list(values[: len(columns)]), values[-1] if tweaked else [None] * len(values[0])
                done = [
                    (None, []) if t is None else replacer(t, {(x["kind"], x["entity"]): x["tweak"] for x in w or ()})
                    for t, w in zip(own[at], tweaks, strict=True)
                ]
                own[at] = [t for t, _ in done]
                return *own, [[dict(zip(("kind", "entity", "new"), e, strict=True)) for e in es] for _, es in done]

            return many

        return per_batch(rows, schema, make, [*columns, "_tweaks"] if tweaked else columns, rows=512)

    done = written(run(docs, False))
    tweaks, before = None, float("inf")
    for tweak in itertools.count(1):
        entities = done.filter(F.size("_entities") > 0).select(F.explode("_entities").alias("e")).select("e.*")
        wrong = written(collisions(entities).withColumn("tweak", F.lit(tweak)))
        n = wrong.count()
        if n == 0:
            break
        if tweak > TWEAKS and n >= before:
            raise ValueError(f"{n} entities keep themselves or share a surrogate after {tweak - 1} tweaks")
        before = n
        # entities that collide are few, but need not be: they go to their texts by a join
        tweaks = wrong if tweaks is None else written(tweaks.join(wrong, ["kind", "entity"], "left_anti").unionByName(wrong))
        found = docs.withColumn("_th", F.xxhash64(text))
        mentions = per_batch(
            found.filter(F.col(text).isNotNull()).select("_th", text),
            "th bigint, kind string, entity string",
            lambda: _mentions,
            ["_th", text],
        ).distinct()
        each = mentions.join(tweaks, ["kind", "entity"]).groupBy("th").agg(F.collect_list(F.struct("kind", "entity", "tweak")).alias("_tweaks"))
        done = written(run(found.join(each, found["_th"] == each["th"], "left").select(*columns, "_tweaks"), True))
    return done


def _mentions(hashes, texts):
    rows = [(h, kind, entity) for h, t in zip(hashes, texts, strict=True) for _, _, kind, entity in find(t)]
    return zip(*rows, strict=True) if rows else ((), (), ())


def _entity_schema(docs: DataFrame) -> StructType:
    return docs.sparkSession.createDataFrame([], f"_entities {_ENTITIES}").schema


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``n_chars``, where there, follows."""
    out, names = replace(docs, key), docs.columns
    kept = {c: F.col(f"_c{k}") for k, c in enumerate(names)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.size("_entities") > 0, F.length(kept["text"])).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in kept.items()])


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, the number of each type, and the text with surrogates, of each row."""
    out = replace(docs.select("doc_id", "text"), key)
    each = [F.size(F.filter("_entities.kind", _is(k))).cast("bigint").alias(f"n_{k}") for k in TYPES]
    return out.select(F.col("_c0").alias("doc_id"), F.size("_entities").cast("bigint").alias("n_entities"), *each, F.col("_c1").alias("text"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind
