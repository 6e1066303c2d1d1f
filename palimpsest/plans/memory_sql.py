"""SQL of the derived evidence memory, as WITH clauses that the twins of the queries start from."""

from __future__ import annotations

T96, T97, T98 = 833_587_200_000_000, 852_076_800_000_000, 896_659_200_000_000
DAY = 86_400_000_000

ORDER_FACTS = f"""
order_facts AS (
  SELECT id, source, relation, target, valid_from, valid_until, recorded_at, confidence,
         CASE WHEN status <> 'F' THEN lag(id) OVER (PARTITION BY source, relation ORDER BY recorded_at, id) END AS supersedes
  FROM (
    SELECT 'fact:o:' || o_orderkey AS id, 'customer:' || o_custkey AS source,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'supports' WHEN '2-HIGH' THEN 'supports' WHEN '3-MEDIUM' THEN 'caused_by'
                WHEN '4-NOT SPECIFIED' THEN 'depends_on' WHEN '5-LOW' THEN 'contradicts' END AS relation,
           'nation:' || (o_orderkey % 25) AS target, epoch_us(o_orderdate) AS valid_from,
           CASE WHEN o_orderkey % 5 = 0 THEN epoch_us(o_orderdate) + 365 * {DAY} END AS valid_until,
           epoch_us(o_orderdate) + (o_orderkey % 30) * {DAY} AS recorded_at, 10000 - (o_orderkey * 37) % 9001 AS confidence, o_orderstatus AS status
    FROM orders
  )
)"""

FACTS = f"""{ORDER_FACTS}, facts AS (
  SELECT * FROM order_facts
  UNION ALL SELECT 'fact:c:' || c_custkey, 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 0, NULL, 0, 10000, NULL FROM customer
  UNION ALL SELECT 'fact:s:' || s_suppkey, 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 0, NULL, 0, 9000, NULL FROM supplier WHERE s_suppkey % 10 <> 9
  UNION ALL SELECT 'fact:v:' || c_custkey, 'supplier:' || (c_custkey % 10), 'supported_by', 'customer:' || c_custkey, 0, NULL, 0, 7000, NULL FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'fact:w:' || c_custkey, 'nation:' || (c_custkey % 25), 'supports', 'customer:' || c_custkey, 0, NULL, 0, 6000, NULL FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT 'fact:n:' || n_nationkey, 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, 0, NULL, 0, 8000, NULL FROM nation
  UNION ALL SELECT 'fact:m:' || n_nationkey, 'nation:' || n_nationkey, 'affects', 'nation:' || ((3 * n_nationkey + 1) % 25), 0, NULL, 0, 5000, NULL FROM nation
)"""

RETRACTIONS = f"""gone AS (
  SELECT id AS fact_id, valid_from + 30 * {DAY} AS valid_until, recorded_at + 60 * {DAY} AS recorded_at, 0 AS ord FROM order_facts WHERE substr(id, 8)::BIGINT % 11 = 0
  UNION ALL SELECT id, valid_from + 90 * {DAY}, recorded_at + 120 * {DAY}, 1 FROM order_facts WHERE substr(id, 8)::BIGINT % 22 = 0
), retractions AS (
  SELECT fact_id, arg_max(valid_until, ord) AS valid_until, arg_max(recorded_at, ord) AS recorded_at FROM gone GROUP BY fact_id
)"""

NODES = f"""revisions AS (
  SELECT 'customer:' || c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'decision' WHEN 'BUILDING' THEN 'inference' WHEN 'FURNITURE' THEN 'observation' WHEN 'HOUSEHOLD' THEN 'task' WHEN 'MACHINERY' THEN 'file' END AS kind,
         c_name AS label, c_mktsegment AS repository, CASE WHEN c_custkey % 3 = 0 THEN 'main' ELSE 'release' END AS branch,
         CASE WHEN c_custkey % 20 = 7 THEN {T97} ELSE 0 END AS recorded_at, 0 AS rev, c_custkey AS ck FROM customer
  UNION ALL
  SELECT 'customer:' || c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'decision' WHEN 'BUILDING' THEN 'inference' WHEN 'FURNITURE' THEN 'observation' WHEN 'HOUSEHOLD' THEN 'task' WHEN 'MACHINERY' THEN 'file' END,
         c_name || ' v2', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'main' ELSE 'release' END, {T97}, 1, c_custkey FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'nation:' || n_nationkey, 'observation', n_name, NULL, NULL, 0, 0, NULL FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'decision', r_name, NULL, NULL, 0, 0, NULL FROM region
  UNION ALL SELECT 'supplier:' || s_suppkey, 'inference', s_name, NULL, NULL, 0, 0, NULL FROM supplier
)"""

BASE = f"WITH RECURSIVE {FACTS}, {RETRACTIONS}, {NODES}, supersessions AS (SELECT supersedes AS prior, id AS replacement, valid_from, recorded_at FROM facts WHERE supersedes IS NOT NULL)"


def active(valid_at: int | str, known_at: int | str, name: str = "active", retractions: str = "retractions") -> str:
    return f"""{name} AS (
  SELECT f.* FROM facts f
  WHERE f.recorded_at <= {known_at} AND f.valid_from <= {valid_at} AND (f.valid_until IS NULL OR {valid_at} < f.valid_until)
    AND NOT EXISTS (SELECT 1 FROM supersessions s WHERE s.prior = f.id AND s.recorded_at <= {known_at} AND s.valid_from <= {valid_at})
    AND NOT EXISTS (SELECT 1 FROM {retractions} r WHERE r.fact_id = f.id AND r.recorded_at <= {known_at} AND r.valid_until <= {valid_at})
)"""


def nodes(known_at: int) -> str:
    return f"""nodes AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, rev DESC) AS n FROM revisions WHERE recorded_at <= {known_at}) WHERE n = 1
)"""


def view(valid_at: int, known_at: int) -> str:
    return f"""{BASE}, {active(valid_at, known_at)}, {nodes(known_at)}, view_facts AS (
  SELECT * FROM active WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)
)"""


def node_tokens(n: int = 4) -> str:
    t = lambda c: f"greatest(1, (strlen({c}) + {n - 1}) // {n})"
    attributes = f"CASE WHEN ck IS NULL THEN 0 ELSE {t(chr(39) + 'alias' + chr(39))} + {t(chr(39) + 'external_id.crm' + chr(39))} + {t(chr(39) + 'Cust ' + chr(39) + ' || ck')} + {t(chr(39) + 'CRM-' + chr(39) + ' || ck')} END"
    optional = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE {t(c)} END"
    return f"{t('id')} + {t('kind')} + {t('label')} + {optional('repository')} + {optional('branch')} + {attributes} + 6"


def fact_tokens(n: int = 4) -> str:
    t = lambda c: f"greatest(1, (strlen({c}) + {n - 1}) // {n})"
    origin = "CASE substr(id, 6, 1) WHEN 'o' THEN 'orders' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' WHEN 'm' THEN 'nation' ELSE 'customer' END"
    return f"{t('id')} + {t('source')} + {t('relation')} + {t('target')} + {t(chr(39) + 'record' + chr(39))} + {t(origin)} + {t('id')} + 16"


def stable_hash(*parts: str) -> str:
    """FNV-1a of the SQL texts, each behind its length in eight bytes."""
    number = "lambda x: x::HUGEINT"
    size = lambda p: f"list_transform(range(8), lambda i: ((octet_length(encode({p})) >> (8 * i)) & 255)::HUGEINT)"
    body = lambda p: f"list_transform(range(1, octet_length(encode({p})) + 1), lambda i: ('0x' || hex(encode({p}))[2 * i - 1:2 * i])::HUGEINT)"
    lists = ", ".join(f"{size(p)}, {body(p)}" for p in (f"coalesce({p}, '')" for p in parts))
    both = f"list_concat([14695981039346656037::HUGEINT], flatten([{lists}]))"
    return f"printf('%016x', list_reduce(list_transform({both}, {number}), lambda a, x: ((xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)))"


def crc32c(data: str) -> str:
    """CRC-32C of a blob, by the table of its polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    body = f"list_transform(range(1, octet_length({data}) + 1), lambda i: ('0x' || hex({data})[2 * i - 1:2 * i])::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {body}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]::BIGINT)), 4294967295)::BIGINT"
