"""A plain sequential fold of an event log, as an oracle for the set-based replay."""

from __future__ import annotations


def replay(events):
    """events: dicts in global order. (state, None) or (None, (position, error))."""
    ids, last, streams = set(), -1, {}
    nodes, facts, superseded, retracted = {}, {}, {}, {}
    for e in events:
        at = e["global_position"]
        if e["id"] in ids:
            return None, (at, "DuplicateEvent")
        ids.add(e["id"])
        if at != last + 1 or e["stream_version"] != streams.get(e["stream_id"], -1) + 1:
            return None, (at, "InvalidReplay")
        last, streams[e["stream_id"]] = at, e["stream_version"]
        p = e["payload"]
        if e["event_type"] != p["type"]:
            return None, (at, "InvalidReplay")
        if p["type"] == "node_upserted":
            nodes.setdefault(p["node"]["id"], []).append((e["recorded_at"], at, p["node"]))
        elif p["type"] == "fact_recorded":
            f = p["fact"]
            if f["recorded_at"] != e["recorded_at"]:
                return None, (at, "InvalidReplay")
            if f["valid_until"] is not None and f["valid_until"] <= f["valid_from"]:
                return None, (at, "InvalidValue")
            if f["source"] not in nodes or f["target"] not in nodes:
                return None, (at, "MissingEntity")
            if f["id"] in facts:
                return None, (at, "ConflictingFact")
            if f["supersedes"] is not None:
                if f["supersedes"] not in facts:
                    return None, (at, "MissingFact")
                if f["supersedes"] in superseded:
                    return None, (at, "ConflictingFact")
                superseded[f["supersedes"]] = (f["id"], f["valid_from"], f["recorded_at"])
            facts[f["id"]] = f
        else:
            if p["fact_id"] not in facts:
                return None, (at, "MissingFact")
            if p["valid_until"] <= facts[p["fact_id"]]["valid_from"]:
                return None, (at, "InvalidValue")
            retracted[p["fact_id"]] = (p["valid_until"], e["recorded_at"])
    return (nodes, facts, superseded, retracted), None


def view(state, valid_at, known_at):
    nodes, facts, superseded, retracted = state
    seen = {}
    for key, revisions in nodes.items():
        known = [r for r in revisions if r[0] <= known_at]
        if known:
            seen[key] = max(known, key=lambda r: (r[0], r[1]))[2]["label"]
    live = set()
    for key, f in facts.items():
        s, r = superseded.get(key), retracted.get(key)
        if f["recorded_at"] > known_at or f["valid_from"] > valid_at or (f["valid_until"] is not None and valid_at >= f["valid_until"]):
            continue
        if (s and s[2] <= known_at and s[1] <= valid_at) or (r and r[1] <= known_at and r[0] <= valid_at):
            continue
        if f["source"] in seen and f["target"] in seen:
            live.add(key)
    return seen, live
