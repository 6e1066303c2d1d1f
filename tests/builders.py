"""Builders of small logs."""

from __future__ import annotations

from palimpsest import schema

PROOF = [("test", "suite", None, None)]


def node(id_, kind="file", label=None, repository=None, branch=None, attributes=None):
    return (id_, kind, label or id_, repository, branch, attributes or {})


def fact(id_, source, relation, target, valid_from=0, recorded_at=0, valid_until=None, confidence=10_000, supersedes=None):
    return (id_, source, relation, target, valid_from, valid_until, recorded_at, recorded_at, "a", "s", confidence, PROOF, supersedes)


class Log:
    """Collects events with positions and versions."""

    def __init__(self):
        self.rows, self.versions = [], {}

    def add(self, recorded_at, kind, node=None, fact=None, fact_id=None, valid_until=None, evidence=None, stream="s", id_=None):
        version = self.versions[stream] = self.versions.get(stream, -1) + 1
        at = len(self.rows)
        self.rows.append((id_ or f"e{at}", kind, recorded_at, recorded_at, "a", "s", None, None, (kind, node, fact, fact_id, valid_until, evidence), stream, version, at))
        return self

    def node(self, recorded_at, *args, **kwargs):
        return self.add(recorded_at, "node_upserted", node=node(*args, **kwargs))

    def fact(self, recorded_at, *args, **kwargs):
        return self.add(recorded_at, "fact_recorded", fact=fact(*args, recorded_at=recorded_at, **kwargs))

    def retract(self, recorded_at, fact_id, valid_until):
        return self.add(recorded_at, "fact_retracted", fact_id=fact_id, valid_until=valid_until, evidence=PROOF)

    def frame(self, spark):
        return spark.createDataFrame(self.rows, schema.STORED_EVENT)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())
