"""Surrogates for personal data (operator 9).

Entities (mail addresses, phone numbers, card and account numbers, IP addresses,
identity numbers, secrets, and personal names) are replaced by keyed surrogates of the
same type and format. Names are those behind an honorific, those with a known given
name, and pairs of capitalised words where the words around name a person: an
introduction or signature, a verb of speech, an address or number next to them. What
was found so is replaced wherever the text has it. A surrogate comes from a keyed
permutation (a Feistel network over the places of the entity's characters) of all
entities of that format, so different entities get different surrogates and one entity
the same everywhere; formatting, script, case, valid check digits and a given name's
gender stay.

Spark then checks the distinct entities of the whole corpus: a surrogate that is
itself an entity of the corpus, or that two entities share, is drawn again in the
next attempt. After ROUNDS attempts its format is too full of entities, and names,
addresses and secrets get one character more with each further attempt. Numbers can't
grow: after WIDER of those attempts the ones left take each other's places in a ring,
so that no two share a surrogate and none keeps its own. The few entities with a later
attempt or a place are joined to the documents that hold them.

The key is the caller's. The query takes it from the setting KEY_SETTING (hexadecimal),
and draws one for the run where that is unset: then surrogates can't be told by anyone.

Defined results: null texts stay null; texts without an entity stay as they are;
repeated rows get the same text; an empty table gives no rows; further columns
stay, whatever their names, but n_entities is replaced. Given names and surnames are replaced word by word, so a surname alone
behind an honorific keeps its link to the full name.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import secrets
import unicodedata
import uuid
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.llm.common import map_batches, stored, table, whole_text

KEY_SETTING = "spark.tenura.surrogate.key"
#: Documents with redrawn entities, and those entities, that may be broadcast (some 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
ROUNDS, WIDER = 8, 8

#: Given names by gender and script: the surrogate of one is another of its list.
GIVEN = {
    "female latin": "Alice Amelie Anna Beatriz Camille Carla Carmen Charlotte Clara Claudia Elena Elisa Emma Eva Florence Greta Hannah Helena Ines Irene Isabel Johanna Julia Karin Katharina Laura Lea Lucia Luisa Maria Marie Marta Nadia Nina Nora Olivia Paula Rosa Sarah Silvia Sofia Sophie Susan Teresa Ursula Valerie Vera Victoria".split(),
    "male latin": "Adam Alexander Andreas Anton Antoine Benjamin Carlos Charles Daniel David Diego Dominik Eduardo Emil Felix Fernando Florian Gabriel Georg Hans Henri Hugo Jakob James Javier John Jonas Jorge Julian Karl Laurent Louis Lukas Manuel Markus Martin Matthias Michael Miguel Nicolas Oliver Oscar Pablo Paul Peter Philipp Robert Thomas Victor".split(),
    "female cyrillic": "Анна Вера Дарья Екатерина Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    "male cyrillic": "Александр Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    "female greek": "Αγγελική Άννα Βασιλική Ελένη Ειρήνη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    "male greek": "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Πέτρος".split(),
}
_GIVEN_LIST = {name.lower(): kind for kind, names in GIVEN.items() for name in names}
HONORIFIC = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Señorita|Sra?|Srta|Don|Doña"
#: Words behind which two capitalised words are a name, and verbs before and behind which they are.
INTRODUCTIONS = (
    "my name is", "name:", "name :", "name=", "name =", "contact:", "attn:", "attn.", "signed,", "signed:", "sincerely,", "regards,", "yours,", "mein name ist", "ich heiße",
    "mit freundlichen grüßen", "je m'appelle", "cordialement,", "me llamo", "mi nombre es", "atentamente,",
)
SPEECH = "said says wrote writes told tells asked asks called calls phoned emailed replied replies met".split()
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
#: A word of a name: O'Neil, McDonald and Jean-Luc, too.
_CAP = rf"[{_UPPER}](?:['’][{_UPPER}])?[{_LOWER}]+(?:(?:[-'’][{_UPPER}]?|[{_UPPER}])[{_LOWER}]+)*"

_MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
_V4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_V6 = r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
#: Before a number of four parts: it is a version or a section.
_VERSION = re.compile(r"(?i:\b(?:v|version|ver|release|rev|revision|build|firmware|kernel|section|chapter|no)|§)[ .:]*$")
#: Four single digits at the start of a line number a section.
_SECTION = re.compile(r"\s*(?:\d\.){3}\d\Z")
_MAC = r"(?<![\w:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:])"
_SECRET = r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9+/_\-]{8,}=*)"
_KEYS = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{16,}|xox[abpr]-[A-Za-z0-9\-]{10,})\b"
_HEX = r"(?<!\w)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,}(?!\w)"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
_CARD = r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_PHONE = r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\w)|(?<![\w.+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)|(?<![\w.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w\-])|(?<![\w.+\-/])0\d(?:[ .]\d{2}){4}(?![\w.\-/])|(?<![\w.+\-/])0\d{2,4}[ /]\d{6,8}(?![\w.\-/])|(?<![\w.+\-/])0\d{2,4} \d{3,4} \d{3,4}(?![\w.\-/])"
_NAME = rf"\b(?:{HONORIFIC})\b\.?\s+(?P<titled>{_CAP}(?:[ ]{_CAP})?)|\b(?P<full>(?:{'|'.join(n for v in GIVEN.values() for n in v)})[ ]{_CAP})(?!\w)"
_PAIR = rf"{_CAP}[ ]{_CAP}(?!\w)"
_VERBS = "|".join(SPEECH)
#: Names by the words around them, looked for where a text has one of those; and a name right before an address or number.
_CONTEXT = re.compile(rf"(?:(?i:{'|'.join(map(re.escape, INTRODUCTIONS))}),?)\s*(?P<introduced>{_PAIR})|\b(?P<speaker>{_PAIR})(?=\s+(?:{_VERBS})\b)|\b(?:{_VERBS})\s+(?P<addressed>{_PAIR})")
#: Each of these has a word of this set: a cheap test of a text.
_CONTEXT_WORDS = frozenset("name name: name= contact: attn: attn. signed, signed: sincerely, regards, yours, heiße grüßen grüßen, m'appelle cordialement, llamo nombre atentamente,".split()).union(SPEECH)
_BEFORE = re.compile(rf"\b({_PAIR})\s*[,;:(<]\s*$")

_ALL = re.compile("|".join(f"(?P<{n}>{p})" for n, p in (("mail", _MAIL), ("ip4", _V4), ("ip6", _V6), ("mac", _MAC), ("secret", _SECRET), ("key", _KEYS), ("iban", _IBAN), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE), ("hex", _HEX), ("name", _NAME))))
#: A text holds no entity without one of these: a digit or @; a secret's name and a sign behind names; a name or honorific that a space or dot follows.
_HINT = re.compile(r"[@\d]")
_SECRET_HINTS = ("token", "secret", "passw", "pwd", "key", "auth")
_CAPITAL_WORD = re.compile(r"[A-ZΆ-ΫА-ЯЁ]\w*(?=[.\s])")
_NAME_HINTS = frozenset("Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Srta Don Doña".split()).union(*GIVEN.values())

#: Letters that take each other's places: consonants and vowels by script, with and without marks, in either case.
ALPHABETS = (
    "0123456789",
    "bcdfghjklmnpqrstvwxz", "aeiouy", "çñßšžćčďđğłńňřśşťźżþð", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ",
    "BCDFGHJKLMNPQRSTVWXZ", "AEIOUY", "ÇÑŠŽĆČĎĐĞŁŃŇŘŚŞŤŹŻÞÐ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŸŒ",
    "бвгджзйклмнпрстфхцчшщъь", "аеёиоуыэюяіїє", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "АЕЁИОУЫЭЮЯІЇЄ",
    "βγδζθκλμνξπρσςτφχψ", "αεηιουω", "άέήίόύώϊϋΐΰ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ΑΕΗΙΟΥΩ", "ΆΈΉΊΌΎΏΪΫ",
)


@functools.cache
def alphabet_of(char: str, alphabets: tuple[str, ...]) -> str:
    """The characters that may stand for this one; of other scripts the letters of the same kind near by; none for what isn't replaced."""
    own = next((a for a in alphabets if char in a), "")
    if own or char.isascii() or not char.isalpha() or alphabets is not ALPHABETS:
        return own
    first, kind = ord(char) & ~63, unicodedata.category(char)
    near = (chr(x) for x in range(first, first + 64) if unicodedata.category(chr(x)) == kind)
    return "".join(x for x in near if not any(x in a for a in ALPHABETS))


def luhn(digits: str) -> int:
    """The check digit that belongs behind these digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


@functools.lru_cache(100_000)
def _stream(key: bytes, data: bytes, n: int) -> list[int]:
    out = b""
    while len(out) < 8 * n:
        out += hashlib.blake2b(data + len(out).to_bytes(4, "big"), key=key[:64], digest_size=64).digest()
    return [int.from_bytes(out[8 * k : 8 * k + 8], "big") for k in range(n)]


def permuted(values: list[int], radices: list[int], key: bytes, tweak: bytes) -> list[int]:
    """A keyed permutation of all lists of values below these radices."""
    x = list(values)
    sides = (range(0, len(x), 2), range(1, len(x), 2))
    for r in range(8 if len(x) > 1 else 1):
        to, of = sides[r % 2], sides[1 - r % 2]
        data = tweak + bytes([r]) + b",".join(str(x[k]).encode() for k in of)
        for k, add in zip(to, _stream(key, data, len(to)), strict=True):
            x[k] = (x[k] + add) % radices[k]
    return x


def placed(chars: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """chars with each character replaced by one of its alphabet; others, and the format, stay."""
    kinds = [alphabet_of(c, alphabets) for c in chars]
    use = [k for k, a in enumerate(kinds) if a]
    if not use:
        return chars
    form = "".join(f"<{a[0]}>" if a else c for c, a in zip(chars, kinds, strict=True))
    new = permuted([kinds[k].index(chars[k]) for k in use], [len(kinds[k]) for k in use], key, f"{tweak}|{form}".encode())
    out = list(chars)
    for k, v in zip(use, new, strict=True):
        out[k] = kinds[k][v]
    return "".join(out)


_PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEXES = ("0123456789abcdef", "0123456789ABCDEF")


def script_of(word: str) -> str:
    last = word[-1]
    return "cyrillic" if "\u0400" <= last <= "\u052f" else "greek" if "\u0370" <= last <= "\u03ff" or "\u1f00" <= last <= "\u1fff" else "latin"


def canonical(kind: str, found: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if found.startswith("+") else "") + re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind in ("mail", "ip6", "mac"):
        return found.lower()
    return found


def widened(kind: str, entity: str, more: int) -> str:
    """The entity with so many more characters to replace, where its format may grow."""
    if kind == "surname":
        return entity + {"latin": "a", "cyrillic": "а", "greek": "α"}[script_of(entity)] * more
    if kind == "mail":
        return "a" * more + entity
    return entity + "0" * more if kind in ("secret", "key", "hex") else entity


@functools.lru_cache(100)
def given_order(kind: str, key: bytes, tweak: str) -> list[str]:
    """The given names of a kind in a keyed order."""
    return sorted(GIVEN[kind], key=lambda name: _stream(key, f"{tweak}|{kind}|{name}".encode(), 1))


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a canonical entity."""
    tweak = f"{kind}{attempt}"
    if attempt >= ROUNDS:
        entity = widened(kind, entity, attempt - ROUNDS + 1)
    if kind == "mail":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return placed(f"{local}@{host}", key, f"{tweak}.{top}", _PLAIN[:2]) + f".{top}"
    if kind == "ip4":
        parts = [int(x) for x in entity.split(".")]
        if max(parts) > 255:
            return placed(entity, key, tweak)
        classes = ((0, 1), (1, 127), (127, 128), (128, 224), (224, 256))
        low, high = next(c for c in classes if c[0] <= parts[0] < c[1])
        new = permuted([parts[0] - low, *parts[1:]], [high - low, 256, 256, 256], key, f"{tweak}|{low}".encode())
        return ".".join(map(str, [new[0] + low, *new[1:]]))
    if kind == "card":
        body, last = entity[:-1], int(entity[-1])
        if luhn(body) == last:
            new = placed(body, key, tweak + "valid")
            return f"{new}{luhn(new)}"
        return placed(entity, key, tweak)
    if kind == "iban":
        body = placed(entity[4:], key, tweak + entity[:2], _PLAIN)
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    if kind == "phone":
        head = entity[: 2 if entity.startswith("+1") or entity.startswith("+7") else 3] if entity.startswith("+") else ""
        rest = entity[len(head) :]
        lead = rest[:1] if rest[:1] == "0" else ""
        return head + lead + placed(rest[len(lead) :], key, f"{tweak}{head}", ALPHABETS[:1])
    if kind in ("ip6", "mac"):
        return placed(entity, key, tweak, _HEXES[:1])
    if kind in ("secret", "key", "hex"):
        if re.fullmatch(r"[0-9a-f]+", entity) or re.fullmatch(r"[0-9A-F]+", entity):
            return placed(entity, key, tweak, _HEXES[:1] if entity == entity.lower() else _HEXES[1:])
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-|", entity)[0]
        return head + placed(entity[len(head) :], key, tweak, _PLAIN)
    if kind == "given":
        # each name's is the next one in a keyed order of its list: one pair tells nothing of another
        names = given_order(_GIVEN_LIST[entity.lower()], key, tweak)
        at = next(k for k, n in enumerate(names) if n.lower() == entity.lower())
        return names[(at + 1) % len(names)]
    return placed(entity, key, tweak)


def form(kind: str, entity: str) -> str:
    """The format of a canonical entity, within which entities may take each other's places."""

    def shape(chars: str, alphabets: tuple[str, ...] = ALPHABETS) -> str:
        return "".join(f"<{a[0]}>" if (a := alphabet_of(c, alphabets)) else c for c in chars)

    if kind == "mail":
        rest, _, top = entity.rpartition(".")
        return f"{shape(rest, _PLAIN[:2])}.{top}"
    if kind == "ip4":
        first = int(entity.split(".")[0])
        return str(sum(first >= x for x in (1, 127, 128, 224))) if max(map(int, entity.split("."))) <= 255 else shape(entity)
    if kind == "card":
        return f"{shape(entity)}{luhn(entity[:-1]) == int(entity[-1])}"
    if kind == "iban":
        return entity[:2] + shape(entity[4:], _PLAIN)
    if kind == "phone":
        head = (2 if entity.startswith(("+1", "+7")) else 3) if entity.startswith("+") else 0
        lead = head + (entity[head : head + 1] == "0")
        return entity[:lead] + shape(entity[lead:], ALPHABETS[:1])
    if kind in ("ip6", "mac"):
        return shape(entity, _HEXES[:1])
    if kind in ("secret", "key", "hex"):
        for hexes in _HEXES:
            if not set(entity) - set(hexes):
                return shape(entity, (hexes,))
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-|", entity)[0]
        return head + shape(entity[len(head) :], _PLAIN)
    return _GIVEN_LIST[entity.lower()] if kind == "given" else shape(entity)


def may_hold(text: str) -> bool:
    """False only for texts without an entity, by cheap tests."""
    if _HINT.search(text):
        return True
    if ":" in text or "=" in text:
        low = text.lower()
        if any(x in low for x in _SECRET_HINTS):
            return True
    return not _NAME_HINTS.isdisjoint(_CAPITAL_WORD.findall(text)) or has_context(text)


def has_context(text: str) -> bool:
    """Whether a text has a word that may stand by a name."""
    return not _CONTEXT_WORDS.isdisjoint(text.lower().split())


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical entity) of every entity of a text, in order."""
    if not may_hold(text):
        return []
    out = []
    for m in _ALL.finditer(text):
        kind = m.lastgroup if m.lastgroup in _KINDS else next(k for k in _KINDS if m[k] is not None)
        if kind == "secret":
            begin, end = m.span("secret_value")
            out.append((begin, end, kind, text[begin:end]))
        elif kind == "name":
            out += named(text, *(m.span("titled") if m["titled"] else m.span("full")))
        elif kind == "ip4" and (_VERSION.search(text[max(0, m.start() - 16) : m.start()]) or max(map(int, m[0].split("."))) > 255 or _SECTION.match(text, max(0, text.rfind("\n", 0, m.start()) + 1), m.end())):
            continue
        elif kind == "ip6":
            try:
                ipaddress.ip_address(m[0])
            except ValueError:
                continue
            out.append((*m.span(), kind, canonical(kind, m[0])))
        else:
            out.append((*m.span(), kind, canonical(kind, m[0])))
    return with_context(text, out)


def named(text: str, begin: int, end: int) -> list[tuple[int, int, str, str]]:
    """The given names and surnames of a name."""
    return [(begin + w.start(), begin + w.end(), "given" if w[0].lower() in _GIVEN_LIST else "surname", w[0]) for w in re.finditer(r"\S+", text[begin:end])]


def with_context(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The mentions and, where no other is, names by the words around them, in all their places."""
    full = {m[m.lastgroup] for m in _CONTEXT.finditer(text)} if has_context(text) else set()
    for begin, _, kind, _ in found:
        if kind in ("mail", "phone") and (m := _BEFORE.search(text[max(0, begin - 80) : begin])):
            full.add(m[1])
    if not full:
        return found
    begins = [m[0] for m in found]
    more = []
    for m in re.finditer("|".join(rf"\b{re.escape(x)}(?!\w)" for x in sorted(full, key=len, reverse=True)), text):
        at = bisect_left(begins, m.start())
        free = (at == 0 or found[at - 1][1] <= m.start()) and (at == len(found) or begins[at] >= m.end())
        more += named(text, *m.span()) if free else ()
    return sorted([*found, *more])


_KINDS = ("mail", "ip4", "ip6", "mac", "secret", "key", "iban", "ssn", "card", "phone", "hex", "name")


def dressed(kind: str, found: str, new: str) -> str:
    """A canonical surrogate in the format of the mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(new)
        return "".join(next(chars) if c.isalnum() or c == "+" else c for c in found)
    if kind in ("mail", "ip6", "mac"):
        if found.isupper():
            return new.upper()
        if len(new) == len(found):
            return "".join(n.upper() if f.isupper() else n for n, f in zip(new, found, strict=True))
    return new


def entities(docs: DataFrame) -> DataFrame:
    """(text_hash, kind, entity) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {(h, kind, e) for h, t in zip(batch.column("text_hash").to_pylist(), batch.column("text"), strict=True) for _, _, kind, e in mentions(t.as_py())}
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["text_hash", "kind", "entity"])

    text = whole_text()
    return map_batches(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")), run, "text_hash long, kind string, entity string")


def drawn(distinct: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt and surrogate of each row (kind, entity, attempt)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [surrogate(k, e, key, a) for k, e, a in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    return map_batches(distinct.select("kind", "entity", "attempt"), run, "kind string, entity string, attempt int, surrogate string")


def collided(now: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, entity) of the rows whose surrogate is a name of the corpus or another row's, all but one of those that share it."""
    taken = now.join(names, ["kind", "surrogate"], "left_semi")
    shared = now.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("attempt"), "entity")).alias("first")).filter("n > 1")
    later = now.join(shared, ["kind", "surrogate"]).filter(F.col("entity") != F.col("first.entity")).select(now.columns)
    return stored(taken.unionByName(later).select("kind", "entity").distinct())


def ringed(left: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, place) of entities left over by the draws: the next one left of the same format.

    The surrogates of all others are no entities of the corpus, so places never
    meet them. One left alone takes the first other entity of its format; where the
    corpus has no other, it is drawn until it isn't itself, and only an entity
    without a character to replace stays.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms = [form(k, e) for k, e in zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], ["kind", "entity", "form"])

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = []
        for kind, entity, place in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "place")), strict=True):
            drawn_again = (new for k in range(ROUNDS + WIDER, 1000) if (new := surrogate(kind, entity, key, k)) != entity)
            places.append(place or next(drawn_again, entity))
        return pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("entity"), pa.array(places, pa.string())], ["kind", "entity", "place"])

    schema = "kind string, entity string, form string"
    own = stored(map_batches(left.select("kind", "entity"), run, schema))
    every = map_batches(names.select("kind", F.col("surrogate").alias("entity")), run, schema)
    group = Window.partitionBy("kind", "form").orderBy("entity")
    following = F.coalesce(F.lead("entity").over(group), F.first("entity").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ring = own.withColumn("place", following)
    lone = ring.filter("place = entity").select("kind", "form", F.col("entity").alias("only"))
    other = every.join(lone, ["kind", "form"]).filter("entity != only").groupBy("kind", "form").agg(F.min("entity").alias("other"))
    found = ring.join(other, ["kind", "form"], "left").select("kind", "entity", F.when(F.col("place") != F.col("entity"), F.col("place")).otherwise(F.col("other")).alias("place"))
    return map_batches(found, alone, "kind string, entity string, place string")


def redrawn(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, entity, attempt, place) of the entities whose first surrogate collides; place is the surrogate where draws didn't end.

    Given names are drawn from short public lists, where the surrogate of one is
    always another's name; they are only held apart from each other.
    """
    distinct = stored(found.select("kind", "entity").distinct())
    now = stored(drawn(distinct.withColumn("attempt", F.lit(0)), key))
    names = distinct.filter("kind != 'given'").select("kind", F.col("entity").alias("surrogate"))
    again = collided(now, names)
    for _ in range(rounds + WIDER):
        if again.isEmpty():
            return now.filter("attempt > 0").select("kind", "entity", "attempt", F.lit(None).cast("string").alias("place"))
        redo = drawn(now.join(again, ["kind", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        now = stored(now.join(again, ["kind", "entity"], "left_anti").unionByName(redo))
        again = collided(now, names)
    return now.join(stored(ringed(again, names, key)), ["kind", "entity"], "left").filter("attempt > 0").select("kind", "entity", "attempt", "place")


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int | str], memo: dict) -> tuple[str, int]:
    """A text with its entities replaced, and their number; attempts has an entity's attempt, or its surrogate itself."""
    found = mentions(text)
    out, at = [], 0
    for begin, end, kind, entity in found:
        which = (kind, entity, attempts.get((kind, entity), 0))
        new = memo.get(which)
        if new is None:
            new = which[2] if isinstance(which[2], str) else surrogate(*which[:2], key, which[2])
            if len(memo) < 100_000:
                memo[which] = new
        out += [text[at:begin], dressed(kind, text[begin:end], new)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced, and n_entities added; key is the caller's secret."""
    found = stored(entities(docs.select("text")))
    again = stored(redrawn(found, key))
    docs = docs.drop("n_entities")
    names, redo, of_text = docs.columns, f"redrawn_{uuid.uuid4().hex}", f"text_{uuid.uuid4().hex}"
    if again.isEmpty():
        held = docs.withColumn(redo, F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int,place:string>>"))
    else:
        of = found.join(again, ["kind", "entity"]).distinct().groupBy("text_hash").agg(F.collect_list(F.struct("kind", "entity", "attempt", "place")).alias(redo))
        of = stored(of.withColumnRenamed("text_hash", of_text))
        size = of.agg(F.count("*").alias("rows"), F.sum(F.size(redo)).alias("entities")).first()
        small = size["rows"] <= BROADCAST_ROWS and (size["entities"] or 0) <= BROADCAST_ROWS
        held = docs.withColumn(of_text, F.xxhash64(whole_text())).join(F.broadcast(of) if small else of, of_text, "left").select(*names, redo)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict = {}
        texts, counts = [], []
        for text, drawn_again in zip(batch.column("text"), batch.column(redo).to_pylist(), strict=True):
            new, n = replaced(text.as_py() or "", key, {(r["kind"], r["entity"]): r["place"] or r["attempt"] for r in drawn_again or ()}, memo)
            texts.append(new if text.is_valid else None)
            counts.append(n)
        columns = {name: batch.column(name) for name in names} | {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(held, run, T.StructType([*docs.schema, T.StructField("n_entities", T.LongType())]))


def key_of(spark: SparkSession) -> bytes:
    """The key of the setting, or one drawn for this run."""
    given = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
