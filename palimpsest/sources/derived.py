"""Evidence memory made from the relational test tables: nodes, facts, retractions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Instants of 1996-06-01, 1997-01-01 and 1998-06-01.
T96, T97, T98 = 833_587_200_000_000, 852_076_800_000_000, 896_659_200_000_000
#: Relation by order priority, node kind by market segment.
RELATION = {"1-URGENT": "supports", "2-HIGH": "supports", "3-MEDIUM": "caused_by", "4-NOT SPECIFIED": "depends_on", "5-LOW": "contradicts"}
KIND = {"AUTOMOBILE": "decision", "BUILDING": "inference", "FURNITURE": "observation", "HOUSEHOLD": "task", "MACHINERY": "file"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _of(mapping: dict[str, str], c: Column) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out


def _fact(rows: DataFrame, id_: Column, source: Column, relation: Column, target: Column, confidence: Column, origin: str, valid_from=None, recorded=None, until=None, supersedes=None) -> DataFrame:
    none_long, none_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    since = valid_from if valid_from is not None else F.lit(0).cast("long")
    known = recorded if recorded is not None else F.lit(0).cast("long")
    evidence = F.struct(F.lit("record").alias("kind"), F.lit(origin).alias("source"), id_.alias("locator"), none_text.alias("digest"))
    return rows.select(
        id_.alias("id"),
        source.alias("source"),
        relation.alias("relation"),
        target.alias("target"),
        since.alias("valid_from"),
        (until if until is not None else none_long).alias("valid_until"),
        known.alias("observed_at"),
        known.alias("recorded_at"),
        F.lit("loader").alias("agent_id"),
        F.lit("load-1").alias("session_id"),
        confidence.cast("int").alias("confidence"),
        F.array(evidence).alias("evidence"),
        (supersedes if supersedes is not None else none_text).alias("supersedes"),
    )


def _key(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    since = micros(F.col("o_orderdate"))
    o = o.withColumns({"_from": since, "_known": since + F.col("o_orderkey") % 30 * DAY, "_relation": _of(RELATION, F.col("o_orderpriority")), "_id": _key("fact:o:", "o_orderkey")})
    chain = Window.partitionBy("o_custkey", "_relation").orderBy("_known", "_id")
    o = o.withColumn("_prior", F.when(F.col("o_orderstatus") != "F", F.lag("_id").over(chain)))
    return _fact(
        o,
        F.col("_id"),
        _key("customer:", "o_custkey"),
        F.col("_relation"),
        _key("nation:", F.col("o_orderkey") % 25),
        F.lit(10_000) - F.col("o_orderkey") * 37 % 9001,
        "orders",
        F.col("_from"),
        F.col("_known"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("_from") + 365 * DAY),
        F.col("_prior"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived facts, columns of schema.FACT."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    k = F.col("c_custkey")
    parts = [
        _fact(c, _key("fact:c:", k), _key("customer:", k), F.lit("located_in"), _key("nation:", "c_nationkey"), F.lit(10_000), "customer"),
        _fact(s.filter("s_suppkey % 10 <> 9"), _key("fact:s:", "s_suppkey"), _key("supplier:", "s_suppkey"), F.lit("located_in"), _key("nation:", "s_nationkey"), F.lit(9000), "supplier"),
        _fact(c.filter("c_custkey % 2 = 0"), _key("fact:v:", k), _key("supplier:", k % 10), F.lit("supported_by"), _key("customer:", k), F.lit(7000), "customer"),
        _fact(c.filter("c_custkey % 6 = 0"), _key("fact:w:", k), _key("nation:", k % 25), F.lit("supports"), _key("customer:", k), F.lit(6000), "customer"),
        _fact(n, _key("fact:n:", "n_nationkey"), _key("nation:", "n_nationkey"), F.lit("part_of"), _key("region:", "n_regionkey"), F.lit(8000), "nation"),
        _fact(n, _key("fact:m:", "n_nationkey"), _key("nation:", "n_nationkey"), F.lit("affects"), _key("nation:", (F.col("n_nationkey") * 3 + 1) % 25), F.lit(5000), "nation"),
    ]
    out = order_facts(spark, sf_dir)
    for part in parts:
        out = out.unionByName(part)
    return out


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node revisions with their time, columns of schema.NODE and recorded_at."""
    none = F.lit(None).cast("string")

    def node(rows: DataFrame, id_: Column, kind: Column, label: Column, repository: Column, branch: Column, at: Column, attributes: Column) -> DataFrame:
        return rows.select(
            id_.alias("id"), kind.alias("kind"), label.alias("label"), repository.alias("repository"), branch.alias("branch"), attributes.alias("attributes"), at.cast("long").alias("recorded_at")
        )

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    kind, branch = _of(KIND, F.col("c_mktsegment")), F.when(k % 3 == 0, "main").otherwise("release")
    attributes = F.create_map(F.lit("alias"), F.concat(F.lit("Cust "), k.cast("string")), F.lit("external_id.crm"), F.concat(F.lit("CRM-"), k.cast("string")))
    bare = F.create_map().cast("map<string,string>")
    first = node(c, _key("customer:", k), kind, F.col("c_name"), F.col("c_mktsegment"), branch, F.when(k % 20 == 7, T97).otherwise(0), attributes)
    second = node(c.filter("c_custkey % 4 = 0"), _key("customer:", k), kind, F.concat("c_name", F.lit(" v2")), F.col("c_mktsegment"), branch, F.lit(T97), attributes)
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    zero = F.lit(0)
    return (
        first.unionByName(second)
        .unionByName(node(n, _key("nation:", "n_nationkey"), F.lit("observation"), F.col("n_name"), none, none, zero, bare))
        .unionByName(node(r, _key("region:", "r_regionkey"), F.lit("decision"), F.col("r_name"), none, none, zero, bare))
        .unionByName(node(s, _key("supplier:", "s_suppkey"), F.lit("inference"), F.col("s_name"), none, none, zero, bare))
    )


def retraction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, valid_until, recorded_at, ord; of two for a fact the second overwrites the first."""
    return retractions_of(order_facts(spark, sf_dir))


def retractions_of(facts: DataFrame) -> DataFrame:
    """The retraction events of the facts of orders."""
    f = facts.filter("id LIKE 'fact:o:%'").select("id", "valid_from", "recorded_at").withColumn("k", F.substring("id", 8, 20).cast("long"))
    one = f.filter("k % 11 = 0").select(F.col("id").alias("fact_id"), (F.col("valid_from") + 30 * DAY).alias("valid_until"), (F.col("recorded_at") + 60 * DAY).alias("recorded_at"), F.lit(0).alias("ord"))
    two = f.filter("k % 22 = 0").select(F.col("id").alias("fact_id"), (F.col("valid_from") + 90 * DAY).alias("valid_until"), (F.col("recorded_at") + 120 * DAY).alias("recorded_at"), F.lit(1).alias("ord"))
    return one.unionByName(two)


def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole derived log in replay order keys (phase, recorded_at, id, ord), columns of
    schema.EVENT and stream_id, without positions."""
    nodes, all_facts, gone = node_events(spark, sf_dir), facts(spark, sf_dir), retraction_events(spark, sf_dir)
    nothing = lambda kind: F.lit(None).cast(kind)
    from palimpsest import schema

    node_type, fact_type = schema._struct(schema.NODE), schema._struct(schema.FACT)
    evidence_type = f"array<{schema.EVIDENCE}>"
    node_cols, fact_cols = [x for x in nodes.columns if x != "recorded_at"], all_facts.columns

    def event(rows: DataFrame, phase: int, kind: str, key: Column, order: Column, payload: Column, stream: Column) -> DataFrame:
        return rows.select(
            F.lit(phase).alias("phase"), key.alias("key"), order.alias("ord"), F.concat(F.lit(f"event:{kind}:"), key, F.lit(":"), order.cast("string")).alias("id"), F.lit(kind).alias("event_type"),
            F.col("recorded_at").alias("occurred_at"), F.col("recorded_at"), F.lit("loader").alias("agent_id"), F.lit("load-1").alias("session_id"), nothing("string").alias("correlation_id"),
            nothing("string").alias("causation_id"), payload.cast(schema.PAYLOAD).alias("payload"), stream.alias("stream_id"),
        )

    def payload(kind: str, node=None, fact=None, fact_id=None, until=None, evidence=None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), (nothing(node_type) if node is None else node).alias("node"), (nothing(fact_type) if fact is None else fact).alias("fact"),
            (nothing("string") if fact_id is None else fact_id).alias("fact_id"), (nothing("long") if until is None else until).alias("valid_until"), (nothing(evidence_type) if evidence is None else evidence).alias("evidence"),
        )

    reason = F.array(F.struct(F.lit("record").alias("kind"), F.lit("orders").alias("source"), F.col("fact_id").alias("locator"), nothing("string").alias("digest")))
    return (
        event(nodes, 0, "node_upserted", F.col("id"), (F.col("recorded_at") > 0).cast("int"), payload("node_upserted", node=F.struct(*node_cols)), F.lit("nodes"))
        .unionByName(event(all_facts, 1, "fact_recorded", F.col("id"), F.lit(0), payload("fact_recorded", fact=F.struct(*fact_cols)), F.concat(F.lit("facts:"), F.substring_index("source", ":", 1))))
        .unionByName(event(gone, 2, "fact_retracted", F.col("fact_id"), F.col("ord"), payload("fact_retracted", fact_id=F.col("fact_id"), until=F.col("valid_until"), evidence=reason), F.lit("retractions")))
    )
