"""Retrieval evaluation, the literal baseline and adapters of benchmark formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue
from palimpsest.functions.text import token_set
from palimpsest.sources.json_arrays import BLOCK_BYTES, read_array


def validate(cases: DataFrame, predictions: DataFrame, cutoffs: list[int]) -> None:
    if not cutoffs or min(cutoffs) < 1:
        raise InvalidValue("evaluation.cutoffs must be positive")
    bad = cases.filter("id IS NULL OR id = '' OR category IS NULL OR category = '' OR coalesce(size(relevant_ids), 0) = 0")
    checks = [
        (bad, "case without id, category or relevant ids"),
        (cases.groupBy("id").count().filter("count > 1"), "case id twice"),
        (predictions.groupBy("case_id").count().filter("count > 1"), "prediction twice"),
        (predictions.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_anti"), "prediction of an unknown case"),
    ]
    for rows, text in checks:
        if not rows.isEmpty():
            raise InvalidValue(f"evaluation: {text}")


def case_metrics(cases: DataFrame, predictions: DataFrame, cutoffs: list[int]) -> DataFrame:
    """One row a case and cutoff (repeated cutoffs count as often): id, category, cutoff, hit, recall,
    ndcg, reciprocal_rank. Repeated ranked ids keep their first place; no prediction is a miss."""
    asked = cases.select("id", "category", F.array_distinct("relevant_ids").alias("relevant"))
    ranked = predictions.select(F.col("case_id").alias("id"), F.array_distinct("ranked_ids").alias("ranked"))
    rows = asked.join(ranked, "id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    places = F.filter(F.transform("ranked", lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda p: p.isNotNull())
    rows = rows.withColumn("places", places).withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    top = F.filter("places", lambda p: p <= F.col("cutoff"))
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, p: a + 1 / F.log2(p + 1))
    ideal = gain(F.sequence(F.lit(1), F.least(F.size("relevant"), F.col("cutoff"))))
    return rows.select(
        "id",
        "category",
        "cutoff",
        (F.size(top) > 0).cast("double").alias("hit"),
        (F.size(top) / F.size("relevant")).alias("recall"),
        (gain(top) / ideal).alias("ndcg"),
        F.coalesce(1 / F.get("places", 0), F.lit(0.0)).alias("reciprocal_rank"),
    )


def evaluate(cases: DataFrame, predictions: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(category: null for all, cutoff, cases, hit, recall, ndcg, mrr) in one grouping-sets pass.
    A cutoff given twice is summed twice, as its one entry is added to twice."""
    rows = case_metrics(cases, predictions, cutoffs)
    means = [F.expr(f"sum({c}) / greatest(1, count(DISTINCT id)) AS {c}") for c in ("hit", "recall", "ndcg")]
    return (
        rows.groupingSets([["cutoff"], ["category", "cutoff"]], "category", "cutoff")
        .agg(F.countDistinct("id").alias("cases"), *means, F.avg("reciprocal_rank").alias("mrr"))
        .select("category", "cutoff", "cases", "hit", "recall", "ndcg", "mrr")
    )


def literal_predictions(cases: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """(case_id, ranked_ids): of the case's group the documents with most tokens of the query, then
    by id; documents that share none are ranked too. cases: (id, group_id, query); documents:
    (group_id, id, text)."""
    docs = documents.select("group_id", F.col("id").alias("doc"), F.explode(token_set(F.col("text"))).alias("token"))
    asked = cases.select(F.col("id").alias("case_id"), "group_id", F.explode(token_set(F.col("query"))).alias("token"))
    # Tokens meet tokens; a document that shares none is only looked at where the others are too few, and
    # then among the first 2 * limit of its group.
    scored = asked.join(docs, ["group_id", "token"]).groupBy("case_id", "doc").agg(F.count(F.lit(1)).alias("score"))
    by_id = Window.partitionBy("group_id").orderBy("doc")
    first = documents.select("group_id", F.col("id").alias("doc")).distinct().withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= 2 * limit)
    rest = cases.select(F.col("id").alias("case_id"), "group_id").join(first, "group_id").select("case_id", "doc", F.lit(0).cast("long").alias("score"))
    scored = scored.unionByName(rest).groupBy("case_id", "doc").agg(F.max("score").alias("score"))
    place = Window.partitionBy("case_id").orderBy(F.desc("score"), "doc")
    top = scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)
    return top.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc"))), lambda x: x["doc"]).alias("ranked_ids"))


# ---- adapters: documents (group_id, id, text) and cases (id, group_id, category, query, relevant_ids)

DIALOG = (
    "sample_id string, qa array<struct<question:string,category:bigint,evidence:array<string>>>,"
    " conversation map<string,string>"
)
TURN = "array<struct<speaker:string,dia_id:string,text:string>>"
SESSION = (
    "question_id string, question_type string, question string, haystack_session_ids array<string>,"
    " haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
)


def read_dialogs(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Dialog JSON: conversation.session_N holds turns (speaker, dia_id, text). A file is divided into blocks."""
    return dialogs(read_array(spark, path, DIALOG, block_bytes))


def dialogs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of DIALOG, whose conversation maps session names to JSON texts."""
    sessions = rows.select("sample_id", F.explode("conversation").alias("name", "body")).filter("name LIKE 'session\\_%' AND name NOT LIKE '%\\_date\\_time'")
    turns = sessions.select("sample_id", F.explode(F.from_json("body", TURN)).alias("t"))
    doc = lambda dia: F.concat(F.col("sample_id"), F.lit("::dialog::"), dia)
    documents = turns.select(F.col("sample_id").alias("group_id"), doc(F.col("t.dia_id")).alias("id"), F.concat("t.speaker", F.lit(": "), "t.text").alias("text"))
    qa = rows.select("sample_id", F.posexplode("qa").alias("i", "q"))
    pieces = F.filter(F.transform(F.flatten(F.transform("q.evidence", lambda e: F.split(e, ";"))), lambda e: F.trim(e)), lambda e: e != "")
    asked = qa.select(F.concat("sample_id", F.lit("::qa::"), F.col("i").cast("string")).alias("id"), "sample_id", F.concat(F.lit("locomo_"), F.col("q.category").cast("string")).alias("category"), F.col("q.question").alias("query"), F.explode(F.array_distinct(pieces)).alias("dia"))
    known = asked.withColumn("doc", doc(F.col("dia"))).join(documents.select(F.col("id").alias("doc")), "doc", "left_semi")
    cases = known.groupBy("id", F.col("sample_id").alias("group_id"), "category", "query").agg(F.sort_array(F.collect_set("doc")).alias("relevant_ids"))
    return documents, cases


def read_sessions(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    return sessions(read_array(spark, path, SESSION, block_bytes))


def sessions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session JSON: one document a session; questions whose id ends in _abs are left out."""
    rows = rows.filter(~F.col("question_id").endswith("_abs"))
    if not rows.filter("size(haystack_session_ids) <> size(haystack_sessions)").isEmpty():
        raise InvalidValue("session ids and sessions differ in number")
    doc = lambda s: F.concat(F.col("question_id"), F.lit("::session::"), s)
    zipped = rows.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("z"))
    text = F.array_join(F.transform("z.haystack_sessions", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    documents = zipped.select(F.col("question_id").alias("group_id"), doc(F.col("z.haystack_session_ids")).alias("id"), text.alias("text"))
    cases = rows.select(
        F.col("question_id").alias("id"), F.col("question_id").alias("group_id"), F.col("question_type").alias("category"), F.col("question").alias("query"),
        F.transform("answer_session_ids", lambda s: doc(s)).alias("relevant_ids"),
    )
    return documents, cases


def prepared_problems(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, error) of cases that a prepared benchmark must not have."""
    row = lambda df, text: df.select("id", F.lit(text).alias("error"))
    asked = cases.select("id", "group_id", F.explode("relevant_ids").alias("doc"))
    own = documents.select("group_id", F.col("id").alias("doc"))
    return (
        row(cases.groupBy("id").count().filter("count > 1"), "id twice")
        .union(row(cases.filter("query IS NULL OR trim(query) = ''"), "empty query"))
        .union(row(cases.filter("coalesce(size(relevant_ids), 0) = 0"), "no relevant ids"))
        .union(row(cases.join(documents.select("group_id").distinct(), "group_id", "left_anti"), "unknown group"))
        .union(row(asked.join(own, ["group_id", "doc"], "left_anti").distinct(), "relevant id outside its group"))
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, ranked_ids) from a JSON array or from JSON lines."""
    schema = "case_id string, ranked_ids array<string>"
    head = spark.read.text(path).filter("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1)).limit(1).collect()
    return read_array(spark, path, schema) if head and head[0][0] == "[" else spark.read.json(path, schema=schema)
