"""Table functions of Spark SQL."""

import pytest

from palimpsest.errors import InvalidValue
from palimpsest.operators import linking, table_functions
from palimpsest.operators.table_functions import ExtractionRules

RULES = ExtractionRules((("person", r"[A-ZÉ]\w+"), ("place", r"(?<=at )\w+")), (("met", r"(\w+) met (\w+)"),), 8000)


@pytest.fixture(autouse=True)
def _inputs(spark):
    table_functions.register(spark, RULES)
    rows = [("a", "Éva met Bob at home, Bob left"), ("b", None), ("c", ""), ("d", "nobody met Ann")]
    spark.createDataFrame(rows, "input_id string, content string").createOrReplaceTempView("inputs")


def test_mentions(spark):
    got = spark.sql("SELECT * FROM extract_mentions(TABLE(inputs) PARTITION BY input_id)").collect()
    assert {(r["input_id"], r["ordinal"], r["local_id"], r["kind"], r["label"], tuple(r["span"])) for r in got} == {
        ("a", 0, "m0", "person", "Éva", (0, 4)), ("a", 1, "m1", "person", "Bob", (9, 12)), ("a", 2, "m2", "place", "home", (16, 20)), ("d", 0, "m0", "person", "Ann", (11, 14)),
    }


def test_relations_need_both_mentions(spark):
    got = spark.sql("SELECT input_id, local_id, source, relation, target FROM extract_relations(TABLE(inputs) PARTITION BY input_id)").collect()
    assert [tuple(r) for r in got] == [("a", "r0", "m0", "met", "m1")]


def test_output_keeps_the_rules(spark):
    """What the functions give passes the checks that linking makes of a provider's output."""
    inputs = spark.sql("SELECT input_id, coalesce(content, '') AS content, 0L AS occurred_at FROM inputs")
    mentions, relations = table_functions.RulesProvider(RULES).extract(inputs)
    assert linking.output_problems(inputs, mentions, relations).isEmpty()


def test_retrieval(spark):
    spark.sql("SELECT 't1' AS text_id, 'red blue sky' AS text, map('q1', 'blue red', 'q2', 'green', 'q3', null) AS queries UNION ALL SELECT 't2', null, map('q1', 'blue')").createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM retrieve_literal(TABLE(asked) PARTITION BY text_id)").collect()
    assert [tuple(r) for r in got] == [("t1", "q1", 2)]


@pytest.mark.parametrize("make", [lambda: ExtractionRules(()), lambda: ExtractionRules((("a", "b"),), (("c", "(d)"),)), lambda: ExtractionRules((("a", "b"),), (), 10_001)])
def test_rules_are_checked(make):
    with pytest.raises(InvalidValue):
        make()
