import itertools
import random
import re

from tenura.llm import pii
from tests.llm.test_text_basics import ODD, frame


def swap(text, key=b"k"):
    return pii.replaced(text, key, {}, {})[0]


def test_types_and_formats():
    cases = {
        "mail Anna.B7@mail5.example.com now": r"mail [A-Z][a-z]{3}\.[A-Z]\d@[a-z]{4}\d\.[a-z]{7}\.com now",
        "call +1 (743) 555-3824 or": r"call \+1 \(\d{3}\) \d{3}-\d{4} or",
        "ip 70.23.22.57.": r"ip \d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\.",
        "card 4785 3805 9239 1139!": r"card \d{4} \d{4} \d{4} \d{4}!",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"': r'token = "[0-9a-f]{40}"',
        "ssn 123-45-6789": r"ssn \d{3}-\d{2}-\d{4}",
        "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d",
    }
    for text, pattern in cases.items():
        new = swap(text)
        assert re.fullmatch(pattern, new) and new != text, (text, new)
    valid = "4111111111111111"
    new = swap(f"x {valid} y").split()[1]
    assert new != valid and pii.luhn(new[:-1]) == int(new[-1])
    assert swap("nothing here, 12 or 2024-01-02 or 3.14") == "nothing here, 12 or 2024-01-02 or 3.14"


def test_names_keep_gender_script_and_links():
    new = swap("Anna Keller met Mr Keller and Михаил Петров.")
    m = re.fullmatch(r"(\w+) (\w+) met Mr (\w+) and (\w+) (\w+)\.", new)
    assert m and m[1] in pii.GIVEN["female latin"] and m[2] == m[3] != "Keller"
    assert m[4] in pii.GIVEN["male cyrillic"] and m[4] != "Михаил" and pii.script_of(m[5]) == "cyrillic"


def test_permutations_are_one_to_one():
    for radices in ([5, 4, 3], [7], [2, 2], [3, 5, 2, 2]):
        every = [list(x) for x in itertools.product(*map(range, radices))]
        assert len({tuple(pii.permuted(x, radices, b"k", b"t")) for x in every}) == len(every)
    assert len({pii.surrogate("given", n, b"k") for n in pii.GIVEN["male latin"]}) == len(pii.GIVEN["male latin"])


def test_collisions_are_redrawn(spark):
    first = [f"{a}{b}@x.de" for a in "ab" for b in "abcdefghijklmnopqrst"]
    taken = [pii.surrogate("mail", e, b"k") for e in first[:10]]  # entities that are others' surrogates
    docs = frame(spark, [f"write to {e} or {e.upper()}" for e in first + taken])
    got = [r["text"] for r in pii.with_surrogates(docs, b"k").orderBy("doc_id").collect()]
    new = [re.fullmatch(r"write to (\S+) or (\S+)", t) for t in got]
    assert all(m[1].upper() == m[2] for m in new)
    assert len({m[1] for m in new}) == len(set(first + taken)) and not {m[1] for m in new} & set(first + taken)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in pii.op9_pii(spark, sf).collect()}
    plain = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+|\b\d{16}\b|\b[0-9a-f]{40}\b")
    pairs = {}
    for i, text in old.items():
        before, after = plain.findall(text), plain.findall(got[i]["text"])
        assert len(before) == len(after) and len(text.split()) == len(got[i]["text"].split())
        assert plain.sub("", text) == plain.sub("", got[i]["text"])
        assert got[i]["n_entities"] == len(before)
        for a, b in zip(before, after, strict=True):
            assert a != b and pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


def test_edges(spark):
    docs = frame(spark, ODD).withColumnRenamed("source", "n_entities").withColumnRenamed("digest", "redrawn").withColumnRenamed("lang", "text_hash_of")
    out = pii.with_surrogates(docs, b"k")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == dict(enumerate(ODD))
    assert {(r["redrawn"], r["text_hash_of"]) for r in out.collect()} == {("clash", "en")}
    assert pii.with_surrogates(frame(spark, []), b"k").count() == 0


def test_full_formats_get_wider_ones(spark):
    """All 120 surnames of a capital consonant and a vowel, and 700 of 720 with a second one: no surrogate is anyone's surname."""
    short = [a + b for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiouy"]
    longer = [a + b + c for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiouy" for c in "aeiouy" if (a + b + c).lower() not in pii._GIVEN_LIST][:700]
    real = [*short, *longer]
    docs = frame(spark, [f"so Mr {n} came" for n in real])
    got = [r["text"] for r in pii.with_surrogates(docs, b"k").orderBy("doc_id").collect()]
    new = [re.fullmatch(r"so Mr (\w+) came", t)[1] for t in got]
    assert len(set(new)) == len(new) == 820 and not set(new) & set(real)
    assert all(b.istitle() and len(a) <= len(b) <= len(a) + pii.WIDER for a, b in zip(real, new, strict=True))


def test_full_numbers_take_each_others_places(spark, monkeypatch):
    """Numbers can't grow: where every one of a format is taken, they form a ring."""
    monkeypatch.setattr(pii, "WIDER", 1)
    found = spark.createDataFrame([(0, "phone", f"+1{k:02d}") for k in range(100)], "text_hash long, kind string, entity string")
    got = {r["entity"]: r["place"] for r in pii.redrawn(found, b"k", 1).collect()}
    assert set(got) == {f"+1{k:02d}" for k in range(100)} and set(got.values()) == set(got) and all(a != b for a, b in got.items())


def test_no_letter_stays_beyond_chance():
    names = ["Müller", "Иванов", "Öße", "Κωνσταντίνου", "Ångström", "Щербакова", "Łukasiewicz", "Ñíguez", "Őry", "Þórðarson", "Чайковский"]
    for name in names:
        new = [pii.surrogate("surname", name, bytes([k])) for k in range(60)]
        for place, letter in enumerate(name):
            assert sum(x[place] == letter for x in new) < 30, (name, letter)
        assert all(pii.script_of(x) == pii.script_of(name) and [c.isupper() for c in x] == [c.isupper() for c in name] for x in new)


def test_names_by_context():
    kinds = lambda t: [(k, e) for _, _, k, e in pii.mentions(t)]
    pairs = [("surname", "Priya"), ("surname", "Raghunathan"), ("surname", "Kwame"), ("surname", "Mensah")]
    assert kinds("Priya Raghunathan called Kwame Mensah") == pairs
    assert kinds("My name is Priya Raghunathan. Regards, Kwame Mensah") == pairs
    assert kinds("Priya Raghunathan <p.r@x.org>")[:2] == pairs[:2] and kinds("Priya Raghunathan, +49 30 123 4567")[:2] == pairs[:2]
    # wherever the text has it
    assert kinds("We saw Kwame Mensah there. Name: Kwame Mensah") == pairs[2:] * 2
    for clean in ("Over the Rocky Mountains. The Great Lakes are far. Called it a day", "name of the game", "New York, 2024", "He met the Red Cross, regards the Old Town"):
        assert kinds(clean) == [], clean


def test_addresses_and_numbers():
    kinds = lambda t: [k for _, _, k, _ in pii.mentions(t)]
    for clean in ("version 10.2.33.4", "v2.10.11.12 is out", "1.2.3.4", "Section 12.10.3.41", "999.10.20.30", "at 12:30:45 or ::", "std::vector a::b"):
        assert kinds(clean) == [], clean
    assert kinds("host 10.2.33.4 and 2001:db8::1 or fe80::1:2") == ["ip4", "ip6", "ip6"]
    assert kinds("06 12 34 56 78 or 0171 1234567 or 030/1234567") == ["phone"] * 3
    for entity in ("2001:db8::1", "fe80::1:2"):
        new = pii.surrogate("ip6", entity, b"k")
        assert new != entity and len(new) == len(entity) and new.count(":") == entity.count(":")


def test_distinct_and_the_same_everywhere(spark):
    """Against brute force: every entity has one surrogate in all documents, no two share one, none is an entity."""
    rng = random.Random(2)
    syllables = ["ba", "ce", "di", "fo", "gu", "he", "ja", "ke", "li", "mo"]
    surnames = ["".join(rng.sample(syllables, 2)).title() for _ in range(60)]
    ibans = [f"DE{rng.randrange(10, 99)} {' '.join(str(rng.randrange(1000, 9999)) for _ in range(4))} {rng.randrange(10, 99)}" for _ in range(20)]
    mails = [f"{rng.choice('ab')}{rng.choice('cd')}@{rng.choice('xy')}.de" for _ in range(20)]
    texts = [f"Mr {rng.choice(surnames)} has {rng.choice(ibans)} and {rng.choice(mails)} ok" for _ in range(400)]
    got = [r["text"] for r in pii.with_surrogates(frame(spark, texts), b"k").orderBy("doc_id").collect()]
    form = re.compile(r"Mr (\w+) has ([A-Z0-9 ]+) and (\S+) ok")
    pairs: dict = {}
    for old, new in zip(texts, got, strict=True):
        for a, b in zip(form.fullmatch(old).groups(), form.fullmatch(new).groups(), strict=True):
            assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
    for b in (b for a, b in pairs.items() if a in ibans):
        plain = b.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_surrogates_keep_the_form():
    for kind, entity in (("mail", "a.b7@x1.de"), ("ip4", "70.23.22.57"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("phone", "+4930123456"), ("phone", "0301234567"), ("ssn", "123456789"), ("key", "sk-Ab12Cd34Ef56Gh78"), ("hex", "24be64439e3e49cf46b2d7c90f3602a3"), ("mac", "00:1b:44:11:3a:b7")):
        assert all(pii.form(kind, pii.surrogate(kind, entity, b"k", a)) == pii.form(kind, entity) for a in range(pii.ROUNDS))


def test_short_addresses_inner_capitals_and_national_numbers():
    from tenura.llm.pii import mentions

    found = lambda text: [text[a:b] for a, b, _, _ in mentions(text)]
    assert found("Logged in from 8.8.8.8 and 1.1.1.1 by root") == ["8.8.8.8", "1.1.1.1"] and found("version 1.2.3.4") == []
    assert found("Mr O'Neil and Mrs McDonald saw Dr Jean-Luc Picard") == ["O'Neil", "McDonald", "Jean-Luc", "Picard"]
    assert found("Call 020 7946 0958 now") == ["020 7946 0958"]
    assert mentions("Mr A" + "a" * 50_000 + "1 b") is not None


def test_one_pair_of_given_names_tells_no_other():
    from tenura.llm.pii import GIVEN, surrogate

    for names in GIVEN.values():
        to = {n: surrogate("given", n, b"k" * 32) for n in names}
        assert sorted(to.values()) == sorted(names) and all(a != b for a, b in to.items())
        shifts = {(names.index(b) - names.index(a)) % len(names) for a, b in to.items()}
        assert len(shifts) > len(names) // 3
        assert to != {n: surrogate("given", n, b"j" * 32) for n in names}
