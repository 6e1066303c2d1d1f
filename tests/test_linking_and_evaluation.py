import pytest
from builders import Log
from pyspark.sql import functions as F

from palimpsest.errors import ExtractionFailure, InvalidValue
from palimpsest.functions import text
from palimpsest.operators import evaluation, linking, replay

MENTION = (
    "input_id string, ordinal int, local_id string, kind string, label string, confidence int, stable_id string, aliases array<string>, attributes map<string,string>,"
    " hints array<struct<entity_id:string,confidence:int,source:string>>, span struct<start:int,end:int>"
)
RELATION = "input_id string, ordinal int, local_id string, source string, relation string, target string, confidence int, valid_from bigint, valid_until bigint, span struct<start:int,end:int>"
INPUT = "input_id string, source string, content string, repository string, branch string, occurred_at bigint, recorded_at bigint, agent_id string, session_id string, locator string, digest string"


@pytest.fixture(scope="module")
def catalog(spark):
    log = Log().node(1, "f1", "Function", "Load Data", "repo", "main", {"alias": "loader", "external_id.py": "pkg.LOAD"})
    log.node(1, "f2", "Function", "load-data", "other", "main").node(1, "g1", "Function", "same").node(1, "g2", "Function", "same")
    return linking.Catalog.from_view(replay.replay(log.frame(spark)).projection.view(5, 5))


def mention(n, label, aliases=(), attributes=None, stable=None, hints=(), confidence=10_000, kind="function", span=None):
    return ("i", n, f"m{n}", kind, label, confidence, stable, list(aliases), attributes or {}, list(hints), span)


def one_input(spark):
    return spark.createDataFrame([("i", "src", "héllo world", "repo", "main", 3, 4, "a", "s", None, None)], INPUT)


def test_links(spark, catalog):
    rows = [
        mention(0, "LOAD  data"),
        mention(1, "x", attributes={"external_id.py": "PKG.load"}),
        mention(2, "y", aliases=["Loader"]),
        mention(3, "z", hints=[("f2", 10_000, "p")]),
        mention(4, "same"),
        mention(5, "new thing", kind="Odd Kind!"),
        mention(6, "w", stable="f1"),
        mention(7, "v", stable="fresh"),
    ]
    decisions, _ = catalog.link(spark.createDataFrame(rows, MENTION), one_input(spark))
    got = {r["local_id"]: (r["entity_id"], r["score"], r["method"]) for r in decisions.collect()}
    assert got["m0"] == ("f1", 9600, "scoped_label")
    assert got["m1"] == ("f1", 10_000, "external_id")
    assert got["m2"] == ("f1", 9100, "alias")
    assert got["m3"] == ("f2", 8200, "provider_hint")
    assert got["m4"][0] is None and got["m4"][2] == "ambiguous"
    assert got["m5"][0].startswith("auto:odd-kind:") and got["m5"][2] == "created"
    assert got["m6"] == ("f1", 10_000, "stable_id") and got["m7"] == ("fresh", 10_000, "created")
    clash = spark.createDataFrame([mention(0, "w", stable="f1", kind="class")], MENTION)
    with pytest.raises(ExtractionFailure):
        catalog.link(clash, one_input(spark))


class Fixed:
    name = "fixed"

    def __init__(self, mentions, relations):
        self.found = mentions, relations

    def extract(self, inputs):
        return self.found


def test_plan_is_idempotent_and_appends(spark, catalog):
    mentions = spark.createDataFrame([mention(0, "LOAD data"), mention(1, "brand new", aliases=["bn"]), mention(2, "brand  NEW"[:6] + "new", aliases=["bn", "b2"]), mention(3, "same")], MENTION)
    mentions = mentions.withColumn("label", F.when(F.col("ordinal") == 2, "brand new").otherwise(F.col("label")))
    relations = spark.createDataFrame([("i", 0, "r0", "m0", "calls", "m1", 9000, None, None, (0, 3)), ("i", 1, "r1", "m0", "calls", "m3", 9000, None, None, None)], RELATION)
    plans = [linking.plan(Fixed(mentions, relations), one_input(spark), catalog) for _ in range(2)]
    events = [sorted(r["id"] for r in p.events.collect()) for p in plans]
    assert events[0] == events[1] and len(events[0]) == 2
    rows = {r["event_type"]: r["payload"] for r in plans[0].events.collect()}
    assert rows["node_upserted"]["node"]["attributes"] == {"extracted_by": "fixed", "extraction_source": "src", "alias.0": "bn", "alias.3": "b2"}
    fact = rows["fact_recorded"]["fact"]
    assert fact["confidence"] == 9000 and fact["evidence"][1]["locator"] == "bytes:0-3" and fact["valid_from"] == 3
    assert plans[0].rejected.first()["reason"] == "unresolved endpoints: source=ScopedLabel, target=Ambiguous"
    assert tuple(plans[0].counts().first()) == (1, 1)
    split = spark.createDataFrame([mention(0, "x", span=(0, 2))], MENTION)
    with pytest.raises(InvalidValue):
        linking.plan(Fixed(split, relations.limit(0)), one_input(spark), catalog)


def test_mentions_of_one_new_entity_must_agree(spark, catalog):
    none = spark.createDataFrame([], RELATION)
    two = spark.createDataFrame([mention(0, "New Name"), mention(1, "new name")], MENTION)
    with pytest.raises(ExtractionFailure, match="kind, label or scope"):
        linking.plan(Fixed(two, none), one_input(spark), catalog)
    two = spark.createDataFrame([mention(0, "New Name"), mention(1, "New Name")], MENTION).withColumn("attributes", F.create_map(F.lit("size"), F.col("ordinal").cast("string")))
    with pytest.raises(ExtractionFailure, match="an attribute"):
        linking.plan(Fixed(two, none), one_input(spark), catalog)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normalized(F.lit(" Ab--c ΣΣ! ")).alias("n"),
        text.slug(F.lit("My Kind/of Thing that is very long indeed")).alias("s"),
        text.slug(F.lit("!!")).alias("e"),
        text.is_padded(F.lit("x ")).alias("p"),
        text.tokens_of(F.lit("héé")).alias("t"),
        text.crc32c(F.lit("123456789").cast("binary")).alias("c"),
        F.array_join(text.token_set(F.lit("A ab É ab-cd")), " ").alias("set"),
    ).first()
    assert (row["n"], row["s"], row["e"], row["p"], row["t"], row["set"]) == ("ab c σσ", "my-kind-of-thing-that-is-very-lo", "entity", True, 2, "ab é cd")
    assert row["c"] == 0xE3069283
    assert f"{int(text.fnv1a([b'a'])[0])}" == "12638187200555641996"


def test_crc32c_matches_bitwise():
    def slow(data):
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
        return state ^ 0xFFFFFFFF

    values = [bytes((i * 7 + k) % 256 for k in range(i)) for i in range(0, 200, 13)]
    assert text.crc32c_of(values).tolist() == [slow(v) for v in values]


def test_metrics(spark):
    cases = spark.createDataFrame([("q1", "x", ["a", "b"]), ("q2", "y", ["c"])], "id string, category string, relevant_ids array<string>")
    predictions = spark.createDataFrame([("q1", ["a", "a", "z"]), ("q2", ["z", "c"])], "case_id string, ranked_ids array<string>")
    evaluation.validate(cases, predictions, [1, 2])
    rows = {(r["category"], r["cutoff"]): r for r in evaluation.evaluate(cases, predictions, [1, 2]).collect()}
    assert (rows[None, 1]["hit"], rows[None, 2]["hit"], rows[None, 2]["recall"], rows[None, 2]["mrr"]) == (0.5, 1.0, 0.75, 0.75)
    with pytest.raises(InvalidValue):
        evaluation.validate(cases, predictions, [0])


def test_adapters(spark, tmp_path):
    dialog = '[{"sample_id": "s1", "qa": [{"question": "who?", "category": 2, "evidence": ["D1:1; D1:2", "D9:9"]}], "conversation": {"session_1": [{"speaker": "Ann", "dia_id": "D1:1", "text": "hi"}, {"speaker": "Bo", "dia_id": "D1:2", "text": "yo"}], "session_1_date_time": "now"}}]'
    (tmp_path / "d.json").write_text(dialog)
    documents, cases = evaluation.read_dialogs(spark, str(tmp_path / "d.json"))
    assert sorted(r["text"] for r in documents.collect()) == ["Ann: hi", "Bo: yo"]
    case = cases.first()
    assert case["relevant_ids"] == ["s1::dialog::D1:1", "s1::dialog::D1:2"] and case["category"] == "locomo_2"
    session = '[{"question_id": "q1", "question_type": "t", "question": "what?", "haystack_session_ids": ["h"], "haystack_sessions": [[{"role": "user", "content": "hello"}]], "answer_session_ids": ["h"]}, {"question_id": "q2_abs", "question_type": "t", "question": "no", "haystack_session_ids": [], "haystack_sessions": [], "answer_session_ids": []}]'
    (tmp_path / "s.json").write_text(session)
    documents, cases = evaluation.read_sessions(spark, str(tmp_path / "s.json"))
    assert documents.first()["text"] == "user: hello" and cases.count() == 1
    assert evaluation.prepared_problems(documents, cases).isEmpty()
    (tmp_path / "p.jsonl").write_text('{"case_id": "q1", "ranked_ids": ["x"]}\n')
    assert evaluation.read_predictions(spark, str(tmp_path / "p.jsonl")).first()["ranked_ids"] == ["x"]


def test_mentions_of_one_entity_merge_without_python(spark):
    """As a loop over the mentions in their order does it; a Python call for each group took longer than the rest of the plan."""
    told = [
        ("i", 2, "a", {"kept": "2", "more": "m", "alias.0": "z", "alias.1": "x"}),
        ("i", 1, "a", {"kept": "1", "alias.0": "x", "alias.3": "y"}),
        ("i", 3, "a", {"alias.9": "z", "alias.b": "w", "alias.a": "v"}),
        ("i", 4, "b", {"alias.0": "only"}),
    ]
    rows = spark.createDataFrame([(i, o, e, "k", "l", None, "main", a) for i, o, e, a in told], "input_id string, ordinal int, id string, kind string, label string, repository string, branch string, attributes map<string,string>")
    merged = linking._merged(rows)
    want = {}
    for _, _, entity, attributes in sorted(told, key=lambda t: t[1]):
        if entity not in want:
            want[entity] = dict(attributes)
            continue
        for key, value in sorted(attributes.items()):
            own = want[entity]
            if not key.startswith("alias."):
                own.setdefault(key, value)
            elif value not in [v for k, v in own.items() if k.startswith("alias.")]:
                n = len(own)
                while f"alias.{n}" in own:
                    n += 1
                own[f"alias.{n}"] = value
    assert {r.id: r.attributes for r in merged.collect()} == want
    assert "InPandas" not in merged._jdf.queryExecution().toString()
