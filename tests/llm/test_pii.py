"""Surrogates: coreference, distinctness, and the same type and form."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import pii

SCHEMA = "doc_id bigint, text string"
KEY = "test key"


def replaced(spark, texts, key=KEY):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = {r.doc_id: r for r in pii.replace_entities(docs, key).collect()}
    return [rows[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    "text, kinds, form",
    [
        ("write to Ann.Lee7@mail.corp-x.org now", "email", r"write to [a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.example\.org now"),
        ("call +44 20 7946 0958, please", "phone", r"call \+44 \d\d \d{4} \d{4}, please"),
        ("call (212) 555-0147.", "phone", r"call \(\d{3}\) \d{3}-\d{4}\."),
        ("card 4111 1111 1111 1111 ends", "card", r"card \d{4} \d{4} \d{4} \d{4} ends"),
        ("from 10.1.2.3 today", "ip", r"from 2[45]\d\.\d+\.\d+\.\d+ today"),
        ("Mrs Jane Smith came", "name", r"Mrs [A-Z][a-z]+ [A-Z][a-z]+ came"),
        ("пришёл г-н Иванов домой", "name", r"пришёл г-н [А-ЯЁ][а-яё]+ домой"),
    ],
)
def test_forms(spark, text, kinds, form):
    row = replaced(spark, [text])[0]
    assert row.kinds == kinds and row.n_entities == 1 and re.fullmatch(form, row.text) and row.text != text


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_card_checks_stay_right_or_wrong(spark):
    rows = replaced(spark, ["4111 1111 1111 1111", "4111 1111 1111 1112"])
    assert [luhn(re.sub(r"\D", "", r.text)) for r in rows] == [luhn("4111111111111111"), luhn("4111111111111112")]


def grew_from(name, names, script):
    """A listed name, and nothing but syllables behind it."""
    tails = [name.lower().removeprefix(x.lower()) for x in names if name.lower().startswith(x.lower())]
    return any(re.fullmatch(f"(?:{'|'.join(pii.SYLLABLES[script])})*", t) for t in tails)


def test_gender_and_script(spark):
    rows = replaced(spark, ["Mr Jan Vos", "Ms Jan Vos", "г-жа Анна Белова", "thanks to Peter Vos", "thanks to Mary Vos", "MR JAN VOS"])
    given = [r.text.split()[-2] for r in rows]
    assert grew_from(given[0], pii.NAMES["latin", "m"], "latin") and grew_from(given[1], pii.NAMES["latin", "f"], "latin")
    assert grew_from(given[2], pii.NAMES["cyrillic", "f"], "cyrillic")
    assert grew_from(given[3], pii.NAMES["latin", "m"], "latin") and grew_from(given[4], pii.NAMES["latin", "f"], "latin")
    assert len({r.text.split()[-1].lower() for r in rows if "г-жа" not in r.text}) == 1
    assert rows[5].text == f"MR {rows[0].text[3:].upper()}"


def test_a_person_is_one_through_title_given_and_bare_name(spark):
    text = "Mr John Smith met Mrs. Smith. Smith, said Mr. SMITH, is no Smithson; John Smith agreed. Blacksmith Smiths."
    row = replaced(spark, [text])[0]
    given, family = re.match(r"Mr (\S+) (\S+) met", row.text).groups()
    assert row.text == f"Mr {given} {family} met Mrs. {family}. {family}, said Mr. {family.upper()}, is no Smithson; {given} {family} agreed. Blacksmith Smiths."
    assert row.n_entities == 4


def test_many_names_stay_apart(spark):
    """Far more names than there are listed ones, in both scripts, in one run."""
    from pyspark.sql import functions as F

    n = 20_000
    spell = lambda letters: F.concat(*[F.substring(F.lit(letters), (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int"), F.lit(1)) for k in range(5)])
    latin, russian = F.concat(F.lit("Mr Q"), spell("abcdefghij")), F.concat(F.lit("г-н Щ"), spell("абвгдежзик"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), latin.alias("text")).union(spark.range(n).select(F.col("id") + n, russian))
    found = pii.replace_entities(docs, KEY).agg(F.countDistinct("text").alias("n"), F.count_if(~F.col("text").rlike(r"^(?:Mr [A-Z][a-z]{2,24}|г-н [А-ЯЁ][а-яё]{2,24})$")).alias("odd")).first()
    assert (found.n, found.odd) == (2 * n, 0)


def test_digest_is_an_hmac(spark):
    import hashlib
    import hmac

    key = spark.range(1).select(pii.keyed(KEY, F.lit("ip"), F.lit("10.1.2.3"), F.lit(4)).alias("k")).first().k
    expected = [hmac.new(hashlib.sha256(KEY.encode()).digest(), f"{n}\x1fip\x1f10.1.2.3\x1f4".encode(), "sha256").hexdigest() for n in (1, 2)]
    assert key == "".join(expected)


def test_detection_equals_plain_python(spark):
    """The same patterns, searched by another engine in whole texts."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = [(-1, "Mr. O'Neil-Smith, Señora Paz; +49 30 1234567 or 030/1234567? a.b@c-d.org 4111-1111-1111-1111 10.0.0.1 MARIE CURIE Marie Curie")]
    rows = docs.unionByName(spark.createDataFrame(own, SCHEMA))
    pattern = regex.compile(pii.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    expected = {r.doc_id: len(pattern.findall(r.text or "")) for r in rows.collect()}
    assert {r.doc_id: r.n_entities for r in pii.replace_entities(rows, KEY).collect()} == expected
    assert expected[-1] == 8 and sum(n > 0 for n in expected.values()) > 3


def test_coreference_and_distinctness(spark):
    values = [f"user{i}@site{i % 7}.com" for i in range(300)] + [f"+1 212 555-{i:04d}" for i in range(300)] + [f"10.0.{i // 250}.{i % 250}" for i in range(300)]
    rows = replaced(spark, [f"one {v} two {v.upper() if '@' in v else v}" for v in values] + values)
    shown = []
    for row, value in zip(rows[: len(values)], values, strict=True):
        first, second = re.fullmatch(r"one (.*) two (.*)", row.text).groups()
        assert first == second and row.n_entities == 2
        shown.append(first)
    assert shown == [r.text for r in rows[len(values) :]]
    assert len(set(shown)) == len(values) and not set(shown) & set(values)


def test_telephone_forms(spark):
    values = ["+49 30 1234567", "030 1234567", "06 12 34 56 78", "+33612345678", "+4915112345678", "555-1234", "(030) 1234567", "030/1234567", "+380 44 123 45 67", "+1 (212) 555-0147"]
    kept = ["+49 ", "", "", "+33", "+49", "", "", "", "+380 ", "+1 ("]
    rows = replaced(spark, [f"call {v}, please" for v in values])
    for row, value, start in zip(rows, values, kept, strict=True):
        form = re.escape(start) + re.sub(r"\d", r"\\d", re.escape(value[len(start) :]))
        assert row.kinds == "phone" and row.n_entities == 1 and re.fullmatch(f"call {form}, please", row.text) and value not in row.text
    texts = ["on 2021-05-06 at 12:30", "from 1990 to 2024", "1,234,567 of 0.12345678", "07/2023"]
    assert [r.text for r in replaced(spark, texts)] == texts


def test_names_and_numbers_corefer_in_every_form(spark):
    rows = replaced(spark, ["Mr Smith", "Mr. Smith", "Mr SMITH", "Mr. Smyth", "+1 (212) 555-0147", "+12125550147"])
    name = rows[0].text.removeprefix("Mr ")
    assert [r.text for r in rows[1:3]] == [f"Mr. {name}", f"Mr {name.upper()}"] and name.istitle() and rows[3].text != f"Mr. {name}"
    assert re.sub(r"\D", "", rows[4].text) == re.sub(r"\D", "", rows[5].text)


def test_key_decides(spark):
    text = ["a@b.com 10.1.2.3"]
    assert replaced(spark, text)[0].text == replaced(spark, text)[0].text != replaced(spark, text, "other")[0].text


def test_collisions_are_drawn_again(spark, monkeypatch):
    """Short numbers collide at once by chance: all stay apart."""
    values = [f"{i:02d}-{j:02d}-{k:03d}" for i in range(10, 20) for j in range(10, 20) for k in range(0, 10)]
    rows = replaced(spark, values)
    assert len({r.text for r in rows}) == len(values) and not {r.text for r in rows} & set(values)


@pytest.mark.parametrize(
    "values, form",
    [
        ([f"г-н {a}{b}ов" for a in ("Бел", "Вол", "Гор", "Дам", "Жук", "Зим") for b in ("ан", "ен", "ин", "он", "ун", "ын", "ар", "ер", "ир", "ор")], r"г-н [А-ЯЁ][а-яё]+"),
        ([f"{'abcdefghij'[i % 10]}@site{i}.com" for i in range(100)], r"[a-z]@(x[0-9a-f]+\.)?example\.com"),
    ],
)
def test_a_form_of_few_surrogates_grows(spark, values, form):
    shown = [r.text for r in replaced(spark, values)]
    assert len(set(shown)) == len(values) and not set(shown) & set(values)
    assert all(re.fullmatch(form, x) for x in shown)


def test_numbers_grow_after_their_own_form_is_used_up(spark):
    late = F.lit(pii.ROOMY_DRAWS + 2)
    row = spark.range(1).select(pii.surrogate(KEY, F.lit("phone"), F.lit("5551234"), late, F.lit(0)).alias("d"), pii.surrogate(KEY, F.lit("ip"), F.lit("10.1.2.3"), late, F.lit(0)).alias("ip"))
    row = row.withColumn("shown", pii.weave(F.lit("555-1234"), F.col("d"))).first()
    assert re.fullmatch(r"\d{3}-\d{6}", row.shown) and re.fullmatch(r"2001:db8(:[0-9a-f]{4}){6}", row.ip)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a@b.com", 5), (3, "clean", 5), (3, "clean", 5), (4, "word " * 100_000 + "a@b.com", 5)], SCHEMA + ", n_entities int")
    docs = docs.withColumn("value", F.lit("clash")).withColumn("kind", F.lit("clash"))
    rows = sorted(pii.replace_entities(docs, KEY).collect(), key=str)
    assert len(rows) == 6 and all(r.value == r.kind == "clash" for r in rows)
    found = {r.doc_id: (r.text if r.doc_id != 4 else r.text[-20:], r.n_entities) for r in rows}
    assert found[1] == (None, 0) and found[2] == ("", 0) and found[3] == ("clean", 0)
    assert found[None][1] == 1 and found[4][0].endswith(found[None][0])
    assert pii.replace_entities(docs.filter(F.lit(False)), KEY).collect() == []


def test_both_joins_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = sorted(pii.replace_entities(docs, KEY).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(pii, "MAX_BROADCAST_LISTS", 0)
    monkeypatch.setattr(pii, "MAX_BROADCAST_VALUES", 0)
    assert sorted(pii.replace_entities(docs, KEY).collect(), key=lambda r: r.doc_id) == before
    assert sum(r.n_entities for r in before) > 0


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a@b.com")], SCHEMA)
    assert "Python" not in pii.replace_entities(docs, KEY)._jdf.queryExecution().toString()
