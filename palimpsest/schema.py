"""Fixed schemas. Times are BIGINT microseconds since 1970, confidences basis points 0..10000."""

from __future__ import annotations

CERTAIN = 10_000
EVIDENCE = "struct<kind:string,source:string,locator:string,digest:string>"
NODE = "id string, kind string, label string, repository string, branch string, attributes map<string,string>"
FACT = (
    "id string, source string, relation string, target string, valid_from bigint, valid_until bigint, observed_at bigint, recorded_at bigint,"
    f" agent_id string, session_id string, confidence int, evidence array<{EVIDENCE}>, supersedes string"
)


def _struct(ddl: str) -> str:
    """A flat column list as a struct type (top-level commas only)."""
    out, depth = [], 0
    for piece in ddl.split(","):
        if depth:
            out[-1] += "," + piece
        else:
            name, kind = piece.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
        depth += piece.count("<") - piece.count(">")
    return f"struct<{','.join(out)}>"


PAYLOAD = f"struct<type:string,node:{_struct(NODE)},fact:{_struct(FACT)},fact_id:string,valid_until:bigint,evidence:array<{EVIDENCE}>>"
EVENT = (
    "id string, event_type string, occurred_at bigint, recorded_at bigint, agent_id string, session_id string,"
    f" correlation_id string, causation_id string, payload {PAYLOAD}"
)
STORED_EVENT = EVENT + ", stream_id string, stream_version bigint, global_position bigint"
NODE_REVISION = NODE + ", recorded_at bigint, position bigint"
STORED_FACT = FACT + ", position bigint"
SUPERSESSION = "prior string, replacement string, valid_from bigint, recorded_at bigint"
RETRACTION = "fact_id string, valid_until bigint, recorded_at bigint"
HIT = "provider string, entity string, channel string, score bigint"

#: Orders of enumerations.
CHANNELS = ("literal", "lexical", "semantic", "hybrid")
GAP_KINDS = ("unjustified_decision", "single_source_inference", "low_confidence_foundation", "unstable_knowledge", "stale_evidence")
ACTION_KINDS = ("supersede_duplicate", "review_orphan", "compact_revision_chain")
EVENT_TYPES = ("node_upserted", "fact_recorded", "fact_retracted")
