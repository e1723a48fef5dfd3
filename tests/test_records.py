"""Schemas, authoring, aliases and flags on small records, by rules written out again."""

import json

from pyspark.sql import functions as F

from verdigris.functions import schema
from verdigris.operators import authoring, lookup
from verdigris.operators import vectors as V

GOOD = {"id": "a", "suite": "s", "family": "stable_control", "domain": "d", "language": "en", "user_prompt": "p", "temporal_volatility": "low", "requires_current_verification": False, "tool_mode": "no_tool", "expected_routes": ["answer"], "disallowed_routes": [], "primary_metric": "route_correctness"}
LABEL = {"task_id": "a", "allowed_routes": ["ask"], "preferred_route": "ask", "disallowed_routes": ["refuse"], "failure_modes_to_check": ["no_response"]}


def errors(spark, of, records):
    df = spark.createDataFrame([(k, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(records)], "k int, r string")
    return [r.e for r in df.select("k", of(F.col("r")).alias("e")).orderBy("k").collect()]


def test_task_errors(spark):
    records = [GOOD, {}, GOOD | {"family": "x", "tool_mode": None}, GOOD | {"expected_routes": []}, GOOD | {"expected_routes": "answer"}, GOOD | {"expected_routes": ["answer", "sing", "dance"]}, GOOD | {"disallowed_routes": {"a": 1}, "temporal_volatility": "never", "primary_metric": "f1"}, "no json", "[1]", None]
    got = errors(spark, schema.task_errors, records)
    assert got[0] == []
    assert got[1] == [f"field '{f}': missing" for f in schema.TASK_FIELDS]
    assert got[2] == [f"field 'family': not in {schema.FAMILIES}", f"field 'tool_mode': not in {schema.TOOL_MODES}"]
    assert got[3] == got[4] == ["field 'expected_routes': must be non-empty list"]
    assert got[5] == ["field 'expected_routes': unknown route 'sing'", "field 'expected_routes': unknown route 'dance'"]
    assert got[6] == ["field 'disallowed_routes': must be list", "field 'temporal_volatility': must be low|medium|high", "field 'primary_metric': v0.1 uses 'route_correctness'"]
    assert got[7] == got[8] == got[9] == ["record: not an object"]


def test_label_errors(spark):
    got = errors(spark, schema.label_errors, [LABEL, LABEL | {"preferred_route": "sing", "failure_modes_to_check": ["no_response", "boredom"]}, {k: v for k, v in LABEL.items() if k != "allowed_routes"}, LABEL | {"allowed_routes": [], "disallowed_routes": "refuse"}])
    assert got == [[], ["field 'preferred_route': unknown route 'sing'", "field 'failure_modes_to_check': unknown failure mode 'boredom'"], ["field 'allowed_routes': missing"], ["field 'allowed_routes': must be non-empty list", "field 'disallowed_routes': must be list"]]


def test_authoring_appends_what_is_valid(spark, tmp_path):
    five = "a\n b \r\n\nc\nd\ne"
    rows = [(1, " pat_x_001 ", "t", "i", five, "n1\nn2"), (2, "pat_x_001", "t", "i", five, None), (3, "pat_X_001", "t", "i", five, None), (4, "pat_y_002", "t", " ", five, None), (5, "pat_y_002", "u", "i", "a\nb", None), (6, None, "t", "i", five, None), (7, "pat_y_002", "u", "i", five, None), (8, "pat_z_0011", "u", "i", five, None)]
    forms = spark.createDataFrame(rows, "pos long, id string, topic string, intent string, examples string, negatives string")
    path = f"file://{tmp_path}/store"
    told = {r.pos: r.error for r in authoring.append(forms, path, "now").collect()}
    assert told == {1: None, 2: "id 'pat_x_001' already exists in library", 3: "id must match the form (got 'pat_X_001')", 4: "intent is required", 5: "Need at least 5 examples (got 2).", 6: "id must match the form (got '')", 7: None, 8: "id must match the form (got 'pat_z_0011')"}
    again = authoring.append(forms.filter("pos in (1, 7)"), path, "later")
    assert all("already exists" in r.error for r in again.collect())
    kept = sorted(authoring.stored(spark, path, "id string, examples array<string>, negatives array<string>, history array<struct<event:string>>, topic string").collect())
    assert [(r.id, r.examples, r.negatives, r.history[0].event, r.topic) for r in kept] == [("pat_x_001", list("abcde"), ["n1", "n2"], "created", "t"), ("pat_y_002", list("abcde"), [], "created", "u")]


def test_alias_forms(spark):
    aliases = spark.createDataFrame([("box", 1), ("city", 2), ("gpu", 3), ("bus", 4), ("cities", 5)], "alias string, target int")
    words = ["Boxes ", "cities", "CITY", "what is a GPU?", "(BOX) and GPU", "bus", "busses", "s", "", None, "a Gpu here", "boxs"]
    got = {r.id: r.target for r in lookup.aliases(spark.createDataFrame(list(enumerate(words)), "id int, word string"), aliases).collect()}
    assert got == {0: 1, 1: 5, 2: 2, 3: 3, 4: 1, 5: 4, 6: None, 7: None, 8: None, 9: None, 10: None, 11: 1}


def test_box_flags(spark):
    rows = [(1, "BOX_A", " No "), (1, "BOX_B", "0"), (1, "BOX_S", "maybe"), (1, "BOX_KIWIX", "off"), (2, "BOX_B", "0"), (2, "BOX_W", "TRUE"), (3, "OTHER", "0")]
    got = {}
    for r in V.box_flags(spark.createDataFrame(rows, "k int, setting string, value string"), "k").collect():
        got.setdefault(r.k, {})[r.box] = r.enabled
    on = dict.fromkeys("0ABSK", True)
    assert got == {1: on | {"A": False, "B": False, "K": False}, 2: on, 3: on}
