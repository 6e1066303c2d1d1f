"""The queries of this folder: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat_format, collocations, decontaminate, hyperminhash, lexical, line_rules, ngram_join, pack, pii, secret_scan, toxicity, url_filter, warc
from palimpsest.llm.common import pick, ship, table

BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


#: Surrogates are drawn under this key; a deployment sets its own.
SECRET = "demonstration key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return secret_scan.digest(docs, secret_scan.learn(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.apply_rules(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *counts, "base_failed", "kept", "removed_chars")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), SECRET)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages"), min_payload_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(more)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url")
    return url_filter.judge(pages, BLOCK, ALLOW).select("page_id", "host", "path", "rule", "verdict")


def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


SQL8 = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), b AS (
  SELECT h.page_id, h.host, h.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM h LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM b
"""

#: SHA-1 in SQL gives hex; base32 takes its 160 bits five at a time.
SQL6 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((((('0x' || substr(hex || '00', 1 + (5 * i) // 4, 2))::INTEGER >> (3 - (5 * i) % 4)) & 31)::INTEGER)), 1)), 'string_agg', '') AS payload_digest,
      max(page_id) OVER (PARTITION BY hex) AS kept
  FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM b
"""

SQL7 = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '([<\\[])(/?(?:INST\\]|s>)|/?ROLE\\]|/TURN\\])', '\\1' || '#' || '\\2', 'g') AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 24 + length(role) END)::BIGINT AS formatted_chars,
       false AS rewrites
FROM e GROUP BY conv_id
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL11 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM d
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), walk(x, y) AS (
  SELECT x, x FROM e UNION SELECT walk.x, e.y FROM walk JOIN e ON e.x = walk.y
), m AS (
  SELECT x AS doc_id, min(y) AS least FROM walk GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

SQL12 = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{lexical.TERM}')) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), g AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs
), i AS (
  SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{lexical.TERM}')) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
"""

SQL13 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), l AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM p
), o AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM l, (VALUES (1), (2), (3)) AS t(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), u AS (
  SELECT c.lang, c.phrase, c.k, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS rest FROM c, (VALUES (1), (2)) AS t(cut) WHERE cut < k
), v AS (
  SELECT u.lang, u.phrase, u.k, u.a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.phrase = head JOIN f y ON y.lang = u.lang AND y.phrase = rest
), b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM v) WHERE i = 1
), z AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3
), q AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.lang = b.lang AND z.phrase = b.phrase AND 100 * longer >= 50 * b.a)
), r AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM q
)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_ngram_join": op1_ngram_join,
        "op2_pack": op2_pack,
        "op4_secret_scan": op4_secret_scan,
        "op5_toxicity": op5_toxicity,
        "op3_decontaminate": op3_decontaminate,
        "op9_line_rules": op9_line_rules,
        "op10_pii": op10_pii,
        "op6_warc": op6_warc,
        "op7_chat_format": op7_chat_format,
        "op8_url_filter": op8_url_filter,
        "op11_near_duplicates": op11_near_duplicates,
        "op12_ranked_search": op12_ranked_search,
        "op13_collocations": op13_collocations,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": SQL6, "op7_chat_format": SQL7, "op8_url_filter": SQL8, "op11_near_duplicates": SQL11, "op12_ranked_search": SQL12, "op13_collocations": SQL13}
