"""Entity linking and extraction plans, batched over many inputs.

inputs: input_id, source, content, repository?, branch?, occurred_at, recorded_at, agent_id,
session_id, locator?, digest?. mentions: input_id, ordinal, local_id, kind, label, confidence,
stable_id?, aliases, attributes, hints array<struct<entity_id,confidence,source>>, span?. relations:
input_id, ordinal, local_id, source, relation, target, confidence, valid_from?, valid_until?, span?.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import ExtractionFailure, InvalidValue
from palimpsest.functions.text import exact_key, is_bad_text, normalized, slug, stable_hash
from palimpsest.operators.view import View
from palimpsest.sources.storage import materialize, ship

#: Base scores of the ways to match.
LABEL, ALIAS, EXTERNAL = 9000, 8500, 9700


@dataclass(frozen=True)
class LinkPolicy:
    minimum_score: int = 8000
    minimum_margin: int = 500
    create_unmatched: bool = True

    def __post_init__(self) -> None:
        if not (0 <= self.minimum_score <= 10_000 and 0 <= self.minimum_margin <= 10_000):
            raise InvalidValue("link policy thresholds are basis points")


class ExtractionProvider(Protocol):
    """Gives mentions and relations for inputs."""

    name: str

    def extract(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]: ...


@dataclass(frozen=True)
class Catalog:
    """Key tables of the known entities: entities (id, kind, repository, branch), labels (kind, key,
    id), aliases (kind, key, id), external (kind, name, key, id)."""

    entities: DataFrame
    labels: DataFrame
    aliases: DataFrame
    external: DataFrame

    @staticmethod
    def from_view(view: View) -> Catalog:
        nodes = view.nodes.withColumn("_kind", normalized(F.col("kind")))
        if not view.nodes.groupBy("id").count().filter("count > 1").isEmpty():
            raise InvalidValue("entity_linker.catalog: ids must be unique")
        pairs = nodes.select("id", F.col("_kind").alias("kind"), F.explode(F.coalesce("attributes", F.create_map().cast("map<string,string>"))).alias("name", "value"))
        alias = (F.col("name") == "alias") | F.col("name").startswith("alias.")
        external = F.col("name").startswith("external_id.")
        if not pairs.filter((alias | external) & is_bad_text(F.col("value"))).isEmpty():
            raise InvalidValue("entity_linker: aliases and external ids must be non-empty without outer white space")
        return Catalog(
            nodes.select("id", F.col("_kind").alias("kind"), "repository", "branch"),
            nodes.select(F.col("_kind").alias("kind"), normalized(F.col("label")).alias("key"), "id"),
            pairs.filter(alias).select("kind", normalized(F.col("value")).alias("key"), "id"),
            pairs.filter(external).select("kind", "name", exact_key(F.col("value")).alias("key"), "id"),
        )

    def candidates(self, mentions: DataFrame, inputs: DataFrame) -> DataFrame:
        """(input_id, local_id, entity_id, score, method): of each entity the best score; of equal
        scores the way that comes first: label, alias by label, aliases in order, external ids by
        name, hints in order."""
        m = mentions.filter("stable_id IS NULL").withColumn("_kind", normalized(F.col("kind")))
        m = m.join(inputs.select("input_id", F.col("repository").alias("in_repository"), F.col("branch").alias("in_branch")), "input_id")
        m = m.withColumnRenamed("confidence", "limit")
        own = ["input_id", "local_id", "limit", "in_repository", "in_branch", F.col("_kind").alias("kind")]
        by_label = m.select(*own, normalized(F.col("label")).alias("key"))
        by_alias = m.select(*own, F.posexplode("aliases").alias("at", "alias")).withColumn("key", normalized(F.col("alias")))
        attributes = F.sort_array(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))
        by_name = m.select(*own, F.posexplode(attributes).alias("at", "pair")).filter(F.col("pair.key").startswith("external_id."))
        by_name = by_name.withColumns({"name": F.col("pair.key"), "key": exact_key(F.col("pair.value"))})
        by_hint = m.select(*own, F.posexplode("hints").alias("at", "hint")).withColumns({"id": F.col("hint.entity_id"), "_score": F.col("hint.confidence").cast("int")})
        columns = ["input_id", "local_id", "limit", "in_repository", "in_branch", "id", "base", "method", "phase", "at"]

        def found(rows: DataFrame, base: Column, method: str, phase: int, at: Column) -> DataFrame:
            return rows.withColumns({"base": base, "method": F.lit(method), "phase": F.lit(phase), "at": at}).select(*columns)

        ways = (
            found(by_label.join(self.labels, ["kind", "key"]), F.lit(LABEL), "label", 0, F.lit(0))
            .unionByName(found(by_label.join(self.aliases, ["kind", "key"]), F.lit(ALIAS), "alias", 1, F.lit(0)))
            .unionByName(found(by_alias.join(self.aliases, ["kind", "key"]), F.lit(ALIAS), "alias", 2, F.col("at")))
            .unionByName(found(by_name.join(self.external, ["kind", "name", "key"]), F.lit(EXTERNAL), "external_id", 3, F.col("at")))
            .unionByName(found(by_hint.join(self.entities.select("id", "kind"), ["id", "kind"]), F.col("_score"), "provider_hint", 4, F.col("at")))
        )
        rows = ways.join(self.entities.drop("kind"), "id")
        adjusted, scoped = scope_score(F.col("base"), F.col("repository"), F.col("branch"), F.col("in_repository"), F.col("in_branch"))
        rows = rows.withColumns({"score": F.least(adjusted, F.col("limit").cast("int")), "method": F.when((F.col("method") == "label") & scoped, "scoped_label").otherwise(F.col("method"))})
        first = Window.partitionBy("input_id", "local_id", "id").orderBy(F.desc("score"), "phase", "at")
        return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("input_id", "local_id", F.col("id").alias("entity_id"), "score", "method")

    def link(self, mentions: DataFrame, inputs: DataFrame, policy: LinkPolicy = LinkPolicy()) -> tuple[DataFrame, DataFrame]:
        """decisions (input_id, ordinal, local_id, entity_id?, score, method) and candidates."""
        ship(mentions.sparkSession)
        found = materialize(self.candidates(mentions, inputs), "candidates")
        order = Window.partitionBy("input_id", "local_id").orderBy(F.desc("score"), "entity_id")
        top = found.withColumns({"_n": F.row_number().over(order), "second": F.lead("score").over(order)}).filter("_n = 1")
        top = top.select("input_id", "local_id", F.col("entity_id").alias("best_id"), F.col("score").alias("best"), "second", F.col("method").alias("best_method"))
        known = self.entities.select(F.col("id").alias("stable_id"), F.col("kind").alias("stable_kind"))
        rows = mentions.join(top, ["input_id", "local_id"], "left").join(known, "stable_id", "left").join(inputs.select("input_id", "repository", "branch"), "input_id")
        clash = rows.filter(F.col("stable_kind").isNotNull() & (F.col("stable_kind") != normalized(F.col("kind")))).limit(1).collect()
        if clash:
            raise ExtractionFailure(f"stable id {clash[0]['stable_id']} has another kind")
        made = F.concat(F.lit("auto:"), slug(F.col("kind")), F.lit(":"), stable_hash(F.col("repository"), F.col("branch"), normalized(F.col("kind")), normalized(F.col("label"))))
        rows = rows.withColumn("made", made)
        stable = F.col("stable_id").isNotNull()
        weak = F.col("best").isNull() | (F.col("best") < policy.minimum_score)
        close = F.col("second").isNotNull() & (F.col("best") - F.col("second") < policy.minimum_margin)
        method = (
            F.when(stable & F.col("stable_kind").isNotNull(), "stable_id")
            .when(stable, "created")
            .when(weak, "created" if policy.create_unmatched else "unresolved")
            .when(close, "ambiguous")
            .otherwise(F.col("best_method"))
        )
        rows = rows.withColumn("method", method)
        m = F.col("method")
        entity = F.when(stable, F.col("stable_id")).when(m == "created", F.col("made")).when(m.isin("unresolved", "ambiguous"), F.lit(None)).otherwise(F.col("best_id"))
        score = F.when(stable | (m == "created"), F.col("confidence")).when(m == "unresolved", F.lit(0)).otherwise(F.col("best"))
        decisions = materialize(rows.select("input_id", "ordinal", "local_id", entity.alias("entity_id"), score.cast("int").alias("score"), "method", stable.alias("by_stable_id")), "decisions")
        taken = decisions.filter("method = 'created' AND NOT by_stable_id").join(self.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").limit(1).collect()
        if taken:
            raise ExtractionFailure(f"a new entity would take the id {taken[0]['entity_id']}, which is in use")
        return decisions.drop("by_stable_id"), found


def scope_score(base: Column, repository: Column, branch: Column, in_repository: Column, in_branch: Column) -> tuple[Column, Column]:
    """The score with what the scope adds or takes, and whether a scope fits."""
    step = lambda own, asked, same, other, none: F.when(asked.isNull(), 0).when(own == asked, same).when(own.isNotNull(), other).otherwise(none)
    fits = F.coalesce(repository == in_repository, F.lit(False)) | F.coalesce(branch == in_branch, F.lit(False))
    total = base + step(repository, in_repository, 400, -2000, -300) + step(branch, in_branch, 200, -700, -100)
    return F.greatest(F.lit(0), F.least(F.lit(10_000), total)), fits


def span_problem(content: Column, span: Column) -> Column:
    """True for a span that is empty, outside the content or inside a character (UTF-8 bytes)."""
    size = F.octet_length(content)
    inside = lambda at: (at < size) & (F.conv(F.hex(F.substring(F.encode(content, "UTF-8"), at.cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80)
    return span.isNotNull() & ((span["start"] >= span["end"]) | (span["end"] > size) | (span["start"] < 0) | inside(span["start"]) | inside(span["end"]))


def output_problems(inputs: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(input_id, error) of extraction output that breaks the rules."""
    row = lambda df, text: df.select("input_id", F.lit(text).alias("error"))
    content = inputs.select("input_id", "content", "occurred_at")
    twice = lambda df: df.groupBy("input_id", "local_id").count().filter("count > 1")
    ids = mentions.select("input_id", F.col("local_id").alias("end")).distinct()
    ends = relations.select("input_id", F.col("source").alias("end")).union(relations.select("input_id", "target"))
    start = F.coalesce("valid_from", "occurred_at")
    both = relations.join(content, "input_id")
    return (
        row(twice(mentions), "mention id twice")
        .union(row(twice(relations), "relation id twice"))
        .union(row(ends.join(ids, ["input_id", "end"], "left_anti"), "unknown endpoint"))
        .union(row(mentions.join(content, "input_id").filter(span_problem(F.col("content"), F.col("span"))), "mention span"))
        .union(row(both.filter(span_problem(F.col("content"), F.col("span"))), "relation span"))
        .union(row(both.filter(F.col("valid_until") <= start), "relation valid_until"))
    )


@dataclass(frozen=True)
class Plan:
    """Events ready to append (input_id, phase, ordinal, schema.EVENT), links, rejected relations."""

    events: DataFrame
    links: DataFrame
    candidates: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        return self.events.agg(F.count_if(F.col("event_type") == "node_upserted").alias("node_event_count"), F.count_if(F.col("event_type") == "fact_recorded").alias("fact_event_count"))


def merge_problems(nodes: DataFrame) -> DataFrame:
    """(input_id, id, error) of generated ids whose mentions can't be one entity."""
    several = lambda *columns: F.countDistinct(F.struct(*columns)) > 1
    bare = nodes.groupBy("input_id", "id").agg(several("kind", "label", "repository", "branch").alias("bad")).filter("bad")
    pairs = nodes.select("input_id", "id", F.explode("attributes").alias("key", "value")).filter("NOT startswith(key, 'alias.')")
    values = pairs.groupBy("input_id", "id", "key").agg(several("value").alias("bad")).filter("bad").select("input_id", "id").distinct()
    row = lambda df, text: df.select("input_id", "id", F.lit(f"mentions of one new entity differ in {text}").alias("error"))
    return row(bare, "kind, label or scope").unionByName(row(values, "an attribute"))


def _merged(nodes: DataFrame) -> DataFrame:
    """One node of each generated id of an input, whose mentions agree (merge_problems). A later mention adds
    aliases that are not there yet, numbered from the count of attributes on, and attributes of other names."""
    entry = F.struct(F.col("ordinal"), F.array_sort(F.map_entries("attributes")).alias("more"), F.struct("kind", "label", "repository", "branch").alias("node"))
    told = nodes.groupBy("input_id", "id").agg(F.array_sort(F.collect_list(entry)).alias("told"))

    def add(found: Column, e: Column) -> Column:
        is_alias = e["key"].startswith("alias.")
        known = F.when(is_alias, F.exists(found, lambda x: x["key"].startswith("alias.") & x["value"].eqNullSafe(e["value"]))).otherwise(F.exists(found, lambda x: x["key"] == e["key"]))
        # Of one number more than there are attributes, one is free.
        names = F.transform(F.sequence(F.size(found), 2 * F.size(found)), lambda n: F.concat(F.lit("alias."), n.cast("string")))
        free = F.array_except(names, F.transform(found, lambda x: x["key"]))
        named = F.struct(F.when(is_alias, F.element_at(free, 1)).otherwise(e["key"]).alias("key"), e["value"].alias("value"))
        return F.when(known, found).otherwise(F.concat(found, F.array(named)))

    later = F.flatten(F.transform(F.slice("told", 2, F.greatest(F.size("told") - 1, F.lit(0))), lambda t: t["more"]))
    first = F.element_at("told", 1)
    start = first["more"].cast("array<struct<key:string,value:string>>")
    attributes = F.map_from_entries(F.aggregate(later, start, add))
    return told.select("input_id", "id", first["node"]["kind"].alias("kind"), first["node"]["label"].alias("label"), first["node"]["repository"].alias("repository"), first["node"]["branch"].alias("branch"), attributes.alias("attributes"))


def plan(provider: ExtractionProvider, inputs: DataFrame, catalog: Catalog, policy: LinkPolicy = LinkPolicy()) -> Plan:
    """Nothing is written: the events of new nodes (by id) and of facts (in relation order)."""
    ship(inputs.sparkSession)
    mentions, relations = provider.extract(inputs)
    mentions, relations = materialize(mentions, "mentions"), materialize(relations, "relations")
    bad = output_problems(inputs, mentions, relations).limit(1).collect()
    if bad:
        raise InvalidValue(f"extraction output of {bad[0]['input_id']}: {bad[0]['error']}")
    links, candidates = catalog.link(mentions, inputs, policy)
    name = F.lit(provider.name)
    about = inputs.withColumn("fingerprint", stable_hash(F.col("content")))
    made = links.filter("method = 'created'").select("input_id", "local_id", F.col("entity_id").alias("id"))
    texts = F.transform("aliases", lambda _, i: F.concat(F.lit("alias."), i.cast("string")))
    empty = F.create_map().cast("map<string,string>")
    fixed = F.create_map(F.lit("extracted_by"), name, F.lit("extraction_source"), F.col("source"))
    # A later entry of a key replaces an earlier one.
    pairs = F.concat(F.map_entries(fixed), F.map_entries(F.coalesce("attributes", empty)), F.map_entries(F.coalesce(F.map_from_arrays(texts, F.col("aliases")), empty)))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    nodes = mentions.join(made, ["input_id", "local_id"]).join(about.select("input_id", F.col("source"), "repository", "branch"), "input_id")
    nodes = nodes.select("input_id", "ordinal", "id", "kind", "label", "repository", "branch", F.map_from_entries(last).alias("attributes"))
    nodes = materialize(nodes, "created-mentions")
    bad = merge_problems(nodes).orderBy("input_id", "id").limit(1).collect()
    if bad:
        raise ExtractionFailure(f"{bad[0]['id']} of {bad[0]['input_id']}: {bad[0]['error']}")
    nodes = materialize(_merged(nodes), "created-nodes")
    none = lambda kind: F.lit(None).cast(kind)
    from palimpsest import schema

    def event(rows: DataFrame, kind: str, tag: str, phase: int, ordinal: Column, key: Column, node: Column, fact: Column) -> DataFrame:
        payload = F.struct(F.lit(kind).alias("type"), node.alias("node"), fact.alias("fact"), none("string").alias("fact_id"), none("long").alias("valid_until"), none(f"array<{schema.EVIDENCE}>").alias("evidence"))
        id_ = F.concat(F.lit(f"event:auto:{tag}:"), stable_hash(name, F.col("in_source"), F.col("fingerprint"), key))
        return rows.select(
            "input_id", F.lit(phase).alias("phase"), ordinal.alias("ordinal"), id_.alias("id"), F.lit(kind).alias("event_type"), "occurred_at", "recorded_at", "agent_id", "session_id",
            none("string").alias("correlation_id"), none("string").alias("causation_id"), payload.cast(schema.PAYLOAD).alias("payload"),
        )

    envelope = about.select("input_id", F.col("source").alias("in_source"), "fingerprint", "occurred_at", "recorded_at", "agent_id", "session_id", "locator", "digest")
    node_rows = nodes.join(envelope, "input_id")
    by_id = F.row_number().over(Window.partitionBy("input_id").orderBy("id"))
    node = F.struct("id", "kind", "label", "repository", "branch", "attributes")
    node_events = event(node_rows.withColumn("place", by_id), "node_upserted", "node", 0, F.col("place"), F.col("id"), node, none(schema._struct(schema.FACT)))
    end = lambda side: links.select("input_id", F.col("local_id").alias(side), F.col("entity_id").alias(f"{side}_id"), F.col("score").alias(f"{side}_score"), F.col("method").alias(f"{side}_method"))
    ends = relations.join(end("source"), ["input_id", "source"]).join(end("target"), ["input_id", "target"])
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    shown = lambda c: F.replace(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    # Fixed value: the wording of the reason.
    rejected = ends.filter(~whole).select(
        "input_id", F.col("local_id").alias("relation_id"), F.col("source").alias("source_mention"), F.col("target").alias("target_mention"),
        F.concat(F.lit("unresolved endpoints: source="), shown(F.col("source_method")), F.lit(", target="), shown(F.col("target_method"))).alias("reason"),
    )
    rows = ends.filter(whole).join(envelope, "input_id")
    fact_id = F.concat(F.lit("fact:auto:"), stable_hash(name, F.col("in_source"), F.col("fingerprint"), F.col("local_id"), F.col("source_id"), F.col("relation"), F.col("target_id")))
    rows = rows.withColumn("fact_id", fact_id)
    of_source = F.struct(F.lit("source").alias("kind"), F.col("in_source").alias("source"), F.col("locator").alias("locator"), F.col("digest").alias("digest"))
    place = F.when(F.col("span").isNotNull(), F.concat(F.lit("bytes:"), F.col("span.start").cast("string"), F.lit("-"), F.col("span.end").cast("string")))
    of_provider = F.struct(F.lit("extraction_provider").alias("kind"), name.alias("source"), place.alias("locator"), none("string").alias("digest"))
    fact = F.struct(
        F.col("fact_id").alias("id"), F.col("source_id").alias("source"), "relation", F.col("target_id").alias("target"), F.coalesce("valid_from", "occurred_at").alias("valid_from"), "valid_until",
        F.col("occurred_at").alias("observed_at"), "recorded_at", "agent_id", "session_id", F.least("confidence", "source_score", "target_score").cast("int").alias("confidence"),
        F.array(of_source, of_provider).alias("evidence"), none("string").alias("supersedes"),
    )
    fact_events = event(rows, "fact_recorded", "fact", 1, F.col("ordinal"), F.col("fact_id"), none(schema._struct(schema.NODE)), fact)
    return Plan(node_events.unionByName(fact_events), links, candidates, rejected)
