"""Surrogate generation for personal data, in DataFrame functions alone.

E-mail addresses, telephone numbers, card numbers, IPv4 addresses and names behind a title are
found and each gets a replacement made from a keyed digest of its normal form, so one person's
data keeps one surrogate through the corpus (coreference) and no one without the key can undo it:

* e-mail: letters and digits of the local part change class by class, the domain moves under a
  reserved name with the same number of labels in front;
* telephone: the digits after the country code change, separators and length stay; numbers behind a
  plus, national ones behind a zero, three separated groups and 555-1234 are known;
* card: the digits change, grouping stays, and the check digit stays right or wrong as it was;
* IPv4: a dotted quad of the never-routed block 240.0.0.0/4;
* name: given and family names of the same script and, by title or given name, the same gender, in the
  same letter case. Names stand behind a title or begin with a common given name. A family name has
  one surrogate, whatever title, given name or letter case it comes with, and where the text says it
  again on its own it is replaced too; the same holds for given names of a gender.

Digests are HMACs under the secret. Collision check: over all distinct values of the corpus, no two may
share a surrogate and no surrogate may equal a real value; values that do are drawn again, those alone,
with the next counter until none is left. Forms of few surrogates grow, so that this ends however many
values there are: names have as many syllables as their number asks for and one more a draw, e-mail
domains a longer keyed label; telephone numbers grow by a digit and IPv4 addresses go into
2001:db8::/32 only after `ROOMY_DRAWS` draws in their own form. Only distinct values and distinct entity
lists travel; a text without entities is never shuffled.

Edge cases: null and empty texts have no entities and stay as they are. Repeated rows get equal
results; entity lists that very many rows share are joined by broadcast. An empty table gives an empty
result. Other columns pass through; n_entities (without bare family names) and kinds are replaced where
they exist.
"""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import join_by_size, materialize

#: Distinct entity lists are broadcast up to so many (a few hundred bytes each), else joined by shuffle.
MAX_BROADCAST_LISTS = 20_000
#: Distinct values are broadcast up to so many (some 150 bytes each), else joined by shuffle.
MAX_BROADCAST_VALUES = 100_000
#: Names get so many syllables that there are this many surrogates for each of them.
ROOM = 50
#: Telephone numbers and IPv4 addresses keep their form for so many draws.
ROOMY_DRAWS = 8
#: Titles with their gender, and given and family names by script.
MALE_TITLES, FEMALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
NAMES = {
    ("latin", "m"): ("Adrian", "Bruno", "Conrad", "Damian", "Edgar", "Felix", "Gustav", "Hector", "Ivan", "Julian", "Leon", "Martin", "Oscar", "Victor"),
    ("latin", "f"): ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Marta", "Olivia", "Vera"),
    ("latin", "family"): ("Alder", "Birch", "Cedar", "Dorn", "Elm", "Falk", "Garner", "Holm", "Ives", "Jansen", "Keller", "Lind", "Moran", "Norden", "Orlo", "Palm"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"),
    ("cyrillic", "f"): ("Алла", "Вера", "Дарья", "Елена", "Жанна", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "family"): ("Белых", "Долгих", "Русских", "Седых", "Чёрных", "Шевченко", "Коваленко", "Ткаченко"),
}
SYLLABLES = {
    "latin": ("al", "an", "ar", "bel", "berg", "dal", "den", "el", "en", "er", "in", "is", "lund", "man", "mar", "or", "rad", "son", "stad", "wald"),
    "cyrillic": ("ан", "ар", "бел", "вал", "ган", "дин", "ев", "ел", "зор", "ин", "ка", "ко", "лан", "мер", "нов", "ов", "рад", "сен", "тар", "ян"),
}
#: Common given names, by which a name without a title is known.
GIVEN_M = ("John James Robert Michael William David Richard Thomas Charles Peter Paul Hans Jürgen Klaus Wolfgang Dieter Pierre Jean Philippe Jacques Luc Carlos José Juan Luis Miguel").split()
GIVEN_F = ("Mary Patricia Jennifer Linda Elizabeth Susan Margaret Sarah Karen Nancy Anna Ursula Monika Petra Sabine Marie Françoise Sylvie Nathalie Isabelle Carmen María Lucía Pilar").split()
EMAIL = r"(?<![A-Za-z0-9\p{L}._%+-])[A-Za-z0-9\p{L}][A-Za-z0-9\p{L}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
#: Behind a plus (7 to 15 digits in all, 11 with codes 1 and 7); national ones behind a zero of 9 to 12 digits in groups (no
#: dates), or an area code and a block; three groups; an exchange and four digits.
_NEXT = r"(?:(?: \(|\) ?|[ .-]\(?)?\d)"
_INTERNATIONAL = rf"\+[17]{_NEXT}{{10}}|\+[2-689]{_NEXT}{{6,14}}"
_NATIONAL = r"(?!\d\d[.-]\d\d[.-]\d{4})(?=\d{2,5}[ .-]\d)0[1-9](?:[ .-]?\d){7,10}|\(0[1-9]\d{0,3}\)[ /]?\d{5,8}|0[1-9]\d{0,3}/\d{6,8}"
_GROUPS = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}[ .-]\d{3,4}|(?<!-)[2-9]\d\d-\d{4}(?!-\d)"
PHONE = rf"(?<![\d.])(?:{_INTERNATIONAL}|{_NATIONAL}|{_GROUPS})(?!\d)"
TITLES = tuple(dict.fromkeys((*MALE_TITLES, *FEMALE_TITLES, *(t.upper() for t in MALE_TITLES + FEMALE_TITLES))))
_CAPITALISED = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.? {_CAPITALISED}(?: {_CAPITALISED})?|(?:{'|'.join(GIVEN_M + GIVEN_F)}) {_CAPITALISED})"
#: What a text with an entity has; searched first, as most texts have none.
HINT = rf"@|[0-9][0-9.()/ -]{{5,}}[0-9]|(?:{'|'.join((*TITLES, *GIVEN_M, *GIVEN_F))})\.? \p{{Lu}}"
ANY = f"{EMAIL}|{IP}|{CARD}|{PHONE}|{NAME}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def kind_of(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^{IP}$"), "ip")
        .when(value.rlike(rf"^{CARD}$"), "card")
        .when(value.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def normal(kind: Column, value: Column) -> Column:
    """Equal for spellings of one value; of a name, its family name. Telephone numbers known to be
    international begin with a plus."""
    digits = F.regexp_replace(value, r"\D", "")
    abroad = value.startswith("+") | ((F.length(digits) > 10) & ~digits.startswith("0"))
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.concat(F.when(abroad, "+").otherwise(""), digits))
        .when(kind == "card", digits)
        .when(kind == "name", F.lower(family_of(value)))
        .otherwise(value)
    )


def is_titled(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, " ", 1), r"\.$", "").isin(*TITLES)


def title_of(name: Column) -> Column:
    """The title as it is written, and the space behind it; empty without one."""
    return F.when(is_titled(name), F.concat(F.substring_index(name, " ", 1), F.lit(" "))).otherwise("")


def family_of(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def given_of(name: Column) -> Column:
    """Null where there is none."""
    rest = F.when(is_titled(name), F.regexp_replace(name, "^\\S+ ", "")).otherwise(name)
    return F.when(rest.contains(" "), F.substring_index(rest, " ", 1))


def is_male(name: Column) -> Column:
    title = F.lower(F.regexp_replace(F.substring_index(name, " ", 1), r"\.$", ""))
    return F.when(is_titled(name), title.isin(*[t.lower() for t in MALE_TITLES])).otherwise(given_of(name).isin(*GIVEN_M))


def draw(key: Column, k: Column, n: int | Column) -> Column:
    """The k-th number below n from a value's keyed digest (two hex digests give 60 steps)."""
    at = (k % 60) * 2 + 1
    return F.conv(F.substr(key, at, F.lit(4)), 16, 10).cast("int") % n


def keyed(secret: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Two HMAC-SHA-256 digests of the value, in hex."""
    block = hashlib.sha256(secret.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    hmac = lambda message: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
    base = F.concat_ws("\x1f", kind, value, attempt.cast("string"))
    return F.concat(hmac(F.concat(F.lit("1\x1f"), base)), hmac(F.concat(F.lit("2\x1f"), base)))


def letters_of(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def reshape(key: Column, text: Column) -> Column:
    """Every ASCII letter or digit becomes another of its class; other letters become Latin."""

    def one(c: Column, i: Column) -> Column:
        shift = lambda alphabet: F.substr(F.lit(alphabet), draw(key, i, len(alphabet)) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), shift(DIGITS)).when(c.rlike(r"\p{Lu}"), shift(UPPER)).when(c.rlike(r"\p{L}"), shift(LOWER)).otherwise(c)

    return F.array_join(F.transform(letters_of(text), one), "")


def email_surrogate(key: Column, value: Column, attempt: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    front = F.when(n > 2, reshape(F.reverse(key), F.concat(F.array_join(F.slice(labels, 1, n - 2), "."), F.lit(".")))).otherwise("")
    end = F.when(F.element_at(labels, -1).isin("org", "net"), F.element_at(labels, -1)).otherwise("com")
    label = F.when(attempt > 0, F.concat(F.lit("x"), F.left(F.sha2(key, 256), F.least(2 * attempt, F.lit(62))), F.lit("."))).otherwise("")
    return F.concat(reshape(key, local), F.lit("@"), front, label, F.lit("example."), end)


def new_digits(key: Column, digits: Column, keep: Column) -> Column:
    """The first `keep` digits stay; every other one is drawn."""
    return F.array_join(F.transform(letters_of(digits), lambda c, i: F.when(i < keep, c).otherwise(draw(key, i, 10).cast("string"))), "")


def luhn(digits: Column) -> Column:
    """The weighted sum modulo 10; 0 for a right check digit."""

    def add(a: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(a["i"] % 2 == 1, 2).otherwise(1)
        return F.struct((a["s"] + d - F.when(d > 9, 9).otherwise(0)).alias("s"), (a["i"] + 1).alias("i"))

    return F.aggregate(F.reverse(letters_of(digits)), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), add, lambda a: a["s"] % 10)


def card_digits(key: Column, digits: Column) -> Column:
    """The issuer's first digit, then drawn ones; the last gives the check sum its old remainder."""
    head = new_digits(key, F.left(digits, F.length(digits) - 1), F.lit(1))
    last = F.pmod(luhn(digits) - luhn(F.concat(head, F.lit("0"))), F.lit(10))
    return F.concat(head, last.cast("string"))


def weave(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order, all other characters kept; digits beyond its own follow."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(a: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(a["out"], F.when(is_digit, F.substr(digits, a["k"], F.lit(1))).otherwise(c)).alias("out"),
            (a["k"] + is_digit.cast("int")).alias("k"),
        )

    return F.aggregate(letters_of(value), start, step, lambda a: F.concat(a["out"], F.substr(digits, a["k"], F.length(digits))))


def phone_surrogate(key: Column, value: Column, attempt: Column) -> Column:
    plus, digits = F.when(value.startswith("+"), "+").otherwise(""), F.regexp_replace(value, r"\D", "")
    code = F.when(digits.rlike("^[17]"), 1).when(digits.rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3)
    country = F.when(plus == "+", code).otherwise(F.greatest(F.length(digits) - 10, F.lit(0)))
    return F.concat(plus, new_digits(key, F.concat(digits, F.repeat(F.lit("0"), F.greatest(attempt - ROOMY_DRAWS, F.lit(0)))), country))


def ip_surrogate(key: Column, attempt: Column) -> Column:
    parts = [F.lit(240) + draw(key, F.lit(0), 15), *[draw(key, F.lit(i), 256) for i in (1, 2, 3)]]
    groups = [F.substr(key, F.lit(4 * i + 1), F.lit(4)) for i in range(6)]
    return F.when(attempt > ROOMY_DRAWS, F.concat_ws(":", F.lit("2001:db8"), *groups)).otherwise(F.concat_ws(".", *[p.cast("string") for p in parts]))


def name_surrogate(key: Column, kind: Column, value: Column, syllables: Column) -> Column:
    """A name part in lower case: a listed name and so many drawn syllables; in_case_of() shows it."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x.lower()) for x in names]), draw(key, k, len(names)) + 1)
    first = lambda sort: F.when(cyrillic, pick(NAMES["cyrillic", sort], F.lit(0))).otherwise(pick(NAMES["latin", sort], F.lit(0)))
    stem = F.when(kind == "family", first("family")).when(kind == "given-m", first("m")).otherwise(first("f"))
    more = lambda script: F.transform(F.sequence(F.lit(1), syllables), lambda i: pick(SYLLABLES[script], i))
    grown = F.when(syllables < 1, "").otherwise(F.array_join(F.when(cyrillic, more("cyrillic")).otherwise(more("latin")), ""))
    return F.concat(stem, grown)


def in_case_of(value: Column, name: Column) -> Column:
    return F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(name)).otherwise(F.initcap(name))


def surrogate(secret: str, kind: Column, value: Column, attempt: Column, syllables: Column) -> Column:
    """The replacement of a normal form. kind: email, ip, card, phone, family, given-m or given-f."""
    key = keyed(secret, kind, value, attempt)
    return (
        F.when(kind == "email", email_surrogate(key, value, attempt))
        .when(kind == "ip", ip_surrogate(key, attempt))
        .when(kind == "card", card_digits(key, value))
        .when(kind == "phone", phone_surrogate(key, value, attempt))
        .otherwise(name_surrogate(key, kind, value, syllables + attempt))
    )


def syllables_for(values: DataFrame) -> Column:
    """How many syllables the names of a kind and script need, by their number (six sums)."""
    cyrillic = F.col("normal").rlike(r"\p{IsCyrillic}")
    sizes = values.filter("kind IN ('family', 'given-m', 'given-f')").groupBy("kind", cyrillic.alias("cyrillic")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = F.lit(0)
    for kind, is_cyrillic, n in sizes:
        script = "cyrillic" if is_cyrillic else "latin"
        stems = len(NAMES[script, kind.removeprefix("given-")])
        need = max(0, math.ceil(math.log(ROOM * n / stems, len(SYLLABLES[script])))) if ROOM * n > stems else 0
        out = F.when((F.col("kind") == kind) & (cyrillic == F.lit(is_cyrillic)), need).otherwise(out)
    return out


def dictionary(values: DataFrame, secret: str) -> DataFrame:
    """kind, normal, surrogate for distinct (kind, normal), without collisions."""
    todo, settled, syllables = values.select("kind", "normal"), None, syllables_for(values)
    for attempt in itertools.count():
        made = surrogate(secret, F.col("kind"), F.col("normal"), F.lit(attempt), syllables)
        drawn = materialize(todo.withColumn("surrogate", made), "surrogates")
        first = drawn.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("normal").alias("first")).filter("n > 1")
        bad = drawn.join(first, ["kind", "surrogate"]).filter("normal <> first").select("kind", "normal")
        taken = values.select("kind", F.col("normal").alias("surrogate"))
        taken = taken if settled is None else taken.unionByName(settled.select("kind", "surrogate"))
        bad = materialize(bad.union(drawn.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "normal")).distinct(), "collisions")
        good = drawn.join(bad, ["kind", "normal"], "left_anti")
        settled = good if settled is None else settled.unionByName(good)
        if bad.isEmpty():
            return settled
        todo = bad


def replace_entities(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with the text rewritten, n_entities and kinds (sorted, comma-joined)."""
    found = F.when(F.col(f"`{text}`").rlike(HINT), F.regexp_extract_all(f"`{text}`", F.lit(f"({ANY})"), F.lit(1)))
    rows = docs.drop("n_entities", "kinds").withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    has, key = F.size("_found") > 0, ["_list1", "_list2"]
    rows = rows.withColumns({k: F.when(has, F.xxhash64(F.lit(n), "_found")) for n, k in enumerate(key)})
    lists = materialize(rows.filter(has).groupBy(*key).agg(F.first("_found").alias("_found"), F.count(F.lit(1)).alias("n")), "entity-lists")
    entities = lists.select(*key, F.posexplode("_found").alias("pos", "value"))
    kind = kind_of(F.col("value"))
    value, is_name = F.col("value"), F.col("kind") == "name"
    entities = entities.withColumn("kind", kind)
    entities = entities.withColumns(
        {
            "part": F.when(is_name, "family").otherwise(F.col("kind")),
            "normal": normal(F.col("kind"), value),
            "given": F.when(is_name, F.lower(given_of(value))),
            "given_part": F.when(is_name, F.when(F.coalesce(is_male(value), F.lit(False)), "given-m").otherwise("given-f")),
        }
    )
    entities = materialize(entities, "entities")
    given = entities.filter("given IS NOT NULL").select(F.col("given_part").alias("kind"), F.col("given").alias("normal"))
    values = materialize(entities.select(F.col("part").alias("kind"), "normal").union(given).distinct(), "entity-values")
    table = materialize(dictionary(values, secret), "dictionary")
    few = table.limit(MAX_BROADCAST_VALUES + 1).count() <= MAX_BROADCAST_VALUES
    own = table.select(F.col("kind").alias("part"), "normal", F.col("surrogate").alias("made"))
    of_given = table.select(F.col("kind").alias("given_part"), F.col("normal").alias("given"), F.col("surrogate").alias("made_given"))
    met = entities.join(F.broadcast(own) if few else own, ["part", "normal"]).join(F.broadcast(of_given) if few else of_given, ["given_part", "given"], "left")
    made, family = F.col("made"), in_case_of(family_of(value), F.col("made"))
    woven = weave(value, F.regexp_replace(made, r"\D", ""))
    whole = F.concat(title_of(value), F.when(F.col("made_given").isNull(), "").otherwise(F.concat(in_case_of(given_of(value), F.col("made_given")), F.lit(" "))), family)
    shown = F.when(F.col("kind").isin("card", "phone"), woven).when(is_name, whole).otherwise(made)
    bare = F.when(is_name & (F.length(family_of(value)) > 2), F.struct(family_of(value).alias("name"), family.alias("shown")))
    replaced = (
        met.withColumns({"shown": shown, "bare": bare})
        .groupBy(*key)
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]).alias("_shown"),
            F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
            F.sort_array(F.collect_set("bare")).alias("_bare"),
        )
    )
    replaced = materialize(replaced.join(lists.select(*key, "n"), key), "replacements")
    again = lambda gap: F.aggregate("_bare", gap, lambda g, b: F.regexp_replace(g, F.concat(F.lit(r"(?<!\p{L})\Q"), b["name"], F.lit(r"\E(?![\p{L}'’-])")), b["shown"]))
    rewritten = F.array_join(F.transform(F.split(f"`{text}`", ANY), lambda g, i: F.concat(again(g), F.coalesce(F.get("_shown", i), F.lit("")))), "")
    new = {
        text: F.when(F.col("_shown").isNull(), F.col(f"`{text}`")).otherwise(rewritten),
        "n_entities": F.size("_found").cast("long"),
        "kinds": F.coalesce("kinds", F.lit("")),
    }
    names = [*docs.drop("n_entities", "kinds").columns, "n_entities", "kinds"]
    if replaced.limit(MAX_BROADCAST_LISTS + 1).count() <= MAX_BROADCAST_LISTS:
        return rows.join(F.broadcast(replaced.drop("n")), key, "left").withColumns(new).select(*names)
    joined = join_by_size(rows.filter(has), replaced, key, "n").withColumns(new).select(*names)
    plain = rows.filter(~has).withColumns({"n_entities": F.lit(0).cast("long"), "kinds": F.lit("")})
    return plain.select(*names).unionByName(joined)
