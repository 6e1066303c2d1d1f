"""Providers as table functions of Spark SQL.

`register` makes extraction and retrieval callable from SQL:

    SELECT * FROM extract_mentions(TABLE(inputs) PARTITION BY input_id)
    SELECT * FROM extract_relations(TABLE(inputs) PARTITION BY input_id)
    SELECT * FROM retrieve_literal(TABLE(asked) PARTITION BY text_id)

Spark deals the input table over tasks by its partition columns and gives a function its rows one by one; the
function keeps nothing of one partition for the next. What a provider finds is declared by patterns, so a new one
needs no Python:

    rules = ExtractionRules(mentions=(("person", r"Customer#\\d+"),), relations=(("knows", r"(Customer#\\d+) knows (Customer#\\d+)"),))
    register(spark, rules)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from palimpsest.errors import InvalidValue
from palimpsest.operators.linking import ExtractionProvider
from palimpsest.sources.storage import ship

SPAN = "struct<start:bigint,end:bigint>"
MENTIONS = f"input_id string, ordinal int, local_id string, kind string, label string, confidence int, span {SPAN}"
RELATIONS = f"input_id string, ordinal int, local_id string, source string, relation string, target string, confidence int, span {SPAN}"
HITS = "text_id string, query_id string, score bigint"


@dataclass(frozen=True)
class ExtractionRules:
    """mentions: (kind, pattern), the whole match being the label. relations: (relation, pattern) whose first two
    groups are labels of mentions. A label is one mention of an input, by its first match."""

    mentions: tuple[tuple[str, str], ...]
    relations: tuple[tuple[str, str], ...] = ()
    confidence: int = 10_000

    def __post_init__(self) -> None:
        if not self.mentions:
            raise InvalidValue("extraction rules: at least one kind of mention")
        if not 0 <= self.confidence <= 10_000:
            raise InvalidValue("extraction rules: confidence is in basis points")
        for _, pattern in (*self.mentions, *self.relations):
            re.compile(pattern)
        if any(re.compile(p).groups < 2 for _, p in self.relations):
            raise InvalidValue("extraction rules: a relation's pattern has two groups")

    def mentioned(self, content: str) -> list[tuple[str, str, str, int, int]]:
        """(local_id, kind, label, start, end) in the order of the text; spans are of UTF-8 bytes."""
        found: dict[str, tuple] = {}
        matches = [(m.start(), -m.end(), order, kind, m) for order, (kind, p) in enumerate(self.mentions) for m in re.finditer(p, content) if m.group()]
        for _, _, _, kind, m in sorted(matches, key=lambda x: x[:3]):
            found.setdefault(m.group(), (kind, *_bytes(content, m)))
        return [(f"m{i}", kind, label, start, end) for i, (label, (kind, start, end)) in enumerate(found.items())]

    def related(self, content: str) -> list[tuple[str, str, str, str, int, int]]:
        """(local_id, source, relation, target, start, end) between mentions of the text."""
        names = {label: local for local, _, label, _, _ in self.mentioned(content)}
        matches = sorted(((m.start(), order, relation, m) for order, (relation, p) in enumerate(self.relations) for m in re.finditer(p, content)), key=lambda x: x[:2])
        known = [(names[m.group(1)], relation, names[m.group(2)], *_bytes(content, m)) for _, _, relation, m in matches if m.group(1) in names and m.group(2) in names]
        return [(f"r{i}", *row) for i, row in enumerate(known)]


def _bytes(content: str, m: re.Match) -> tuple[int, int]:
    start = len(content[: m.start()].encode())
    return start, start + len(m.group().encode())


def register(spark: SparkSession, rules: ExtractionRules) -> None:
    """Make extract_mentions, extract_relations and retrieve_literal known to the session's SQL."""
    ship(spark)

    @udtf(returnType=MENTIONS)
    class Mentions:
        def eval(self, row: Row) -> Iterator[tuple]:
            for i, (local, kind, label, start, end) in enumerate(rules.mentioned(row["content"] or "")):
                yield row["input_id"], i, local, kind, label, rules.confidence, (start, end)

    @udtf(returnType=RELATIONS)
    class Relations:
        def eval(self, row: Row) -> Iterator[tuple]:
            for i, (local, source, relation, target, start, end) in enumerate(rules.related(row["content"] or "")):
                yield row["input_id"], i, local, source, relation, target, rules.confidence, (start, end)

    @udtf(returnType=HITS)
    class Literal:
        """Rows text_id, text, queries (a map of query id to text): of each query the tokens that the text shares."""

        def eval(self, row: Row) -> Iterator[tuple]:
            own = _tokens(row["text"] or "")
            for query_id, text in (row["queries"] or {}).items():
                score = len(own & _tokens(text or ""))
                if score:
                    yield row["text_id"], query_id, score

    spark.udtf.register("extract_mentions", Mentions)
    spark.udtf.register("extract_relations", Relations)
    spark.udtf.register("retrieve_literal", Literal)


def _tokens(text: str) -> set[str]:
    """As functions.text.token_set, of ASCII texts."""
    return {t for t in re.split(r"[^\w]|_", text.lower()) if len(t.encode()) > 1}


class RulesProvider(ExtractionProvider):
    """The rules as a provider of linking.plan: its tables come from the table functions."""

    def __init__(self, rules: ExtractionRules, name: str = "rules"):
        self.rules, self.name = rules, name

    def extract(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = inputs.sparkSession
        register(spark, self.rules)
        given = inputs.select("input_id", "content")
        call = lambda name: spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{given}}) PARTITION BY input_id)", given=given)
        none = {"stable_id": F.lit(None).cast("string"), "aliases": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>")}
        none |= {"hints": F.array().cast("array<struct<entity_id:string,confidence:int,source:string>>")}
        times = {c: F.lit(None).cast("bigint") for c in ("valid_from", "valid_until")}
        return call("extract_mentions").withColumns(none), call("extract_relations").withColumns(times)
