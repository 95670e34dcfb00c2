"""JSON in texts, boxed values, files of questions and the tolerant scorer."""

import json

import pytest

from ledgerloom.operators import evaluate
from ledgerloom.sources import questions
from pyspark.sql import functions as F


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": {"b": 2}}\n```', {"a": {"b": 2}}), ('So: {"a": "}{"} and {"b": 1}', {"a": "}{"}), ('{"status": "ok", "v": [1, {"x": "cut', None), ('{"status": "ok", "v": {"x": "cut', {"status": "ok", "v": {"x": "cut"}}),
    ('{"status": "ok",', {"status": "ok"}), ('{"v": {"x": 1}, "w": {', {"x": 1}), ("no", None), (None, None), ("", None), ("[1]", None), ("} {x} {\"k\": \"\\\"}\"}", {"k": '"}'}), ("{bad} {\"a\": 1}", {"a": 1}),
])
def test_first_object(text, want):
    found = questions.first_object(text)
    assert (None if found is None else json.loads(found)) == want


def test_braces_are_matched_in_one_pass():
    import time

    began = time.process_time()
    assert questions.first_object("{" * 300_000) is None and questions.first_object('{"a":' * 100_000) is None
    assert json.loads(questions.first_object("x" * 300_000 + '{"a": 1}')) == {"a": 1}
    assert time.process_time() - began < 5


@pytest.mark.parametrize(("text", "want"), [
    ("so \\boxed{12.5}", ("12.5", "ok")), ("\\boxed{ 36.77\\% }", ("36.77%", "normalized")), ("\\boxed{1}\\boxed{2}", (None, "multiple")), ("\\boxed{1", (None, "unclosed")), ("12", (None, "missing")), (None, (None, "empty")),
    ("\\boxed {無法回答}", ("無法回答", "ok_refusal")), ("\\boxed{\\frac{1}{2}}", ("\\frac{1}{2}", "invalid_value")), ("\\boxed{(1,234)}", ("(1,234)", "ok")),
])
def test_boxed_values(text, want):
    assert questions.boxed_value(text) == want


def test_columns_of_answers(spark):
    df = spark.createDataFrame([("\\boxed{5}", '{"a": 1}'), (None, None), ("x", "y")], "b string, j string")
    got = [(r.b.value, r.b.state, r.j) for r in df.select(questions.boxed(F.col("b")).alias("b"), questions.object_in(F.col("j")).alias("j")).collect()]
    assert got == [("5", "ok", '{"a": 1}'), (None, "empty", None), (None, "missing", None)]


def test_tolerance(spark):
    rows = [
        ("0.35", "0.348", "", True, False), ("34.8%", "0.348", "", True, False), ("34.8", "0.348", "", True, False), ("0.348", "34.8", "", True, False), ("-34.79", "0.34807", "", True, False), ("50", "0.348", "", False, False),
        ("37.8", "0.348", "about 37.8 percent", True, False), ("37.8", "0.348", "about", False, False), ("37.8", "0.348", "%" + "x" * 100, False, False), ("Yes", "yes", "", True, False), ("no", "yes", "", False, False), ("12", "yes", "", False, True),
        (None, "1", "", False, True), ("abc", "1", None, False, True), ("0", "0", "", True, False), ("1,000", "1010", "", True, False),
    ]
    df = spark.createDataFrame(rows, "a string, g string, r string, want boolean, lost boolean")
    right, unreadable = evaluate.tolerant(F.col("a"), F.col("g"), F.col("r"))
    for r in df.select("a", "g", "want", "lost", right.alias("right"), unreadable.alias("unreadable")).collect():
        assert (r.right, r.unreadable) == (r.want, r.lost), r


def test_question_files(spark, tmp_path):
    items = [
        {"id": "1", "pre_text": ["a", "b"], "table": [["h", "v"], ["x", "1"]], "post_text": ["c"], "qa": {"question": " Q? ", "exe_ans": 12.5}}, {"id": "2", "question": "top", "answer": "yes", "qa": {"model_input": [["k", "gold"], ["k2", "more"], ["no text"]]}},
        {"id": "3", "qa": {"question": "no answer"}}, {"id": "4", "answer": "no question"}, {"id": "5", "question": "bare", "exe_ans": 3},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(items[:3], indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps(items[3:]))
    found, skipped = questions.evidence_questions(spark, f"file://{tmp_path}/in")
    assert {r.id: (r.context, r.question, r.answer) for r in found.collect()} == {"1": ("a b\nh | v\nx | 1\nc", "Q?", "12.5"), "2": ("gold\nmore", "top", "yes"), "5": ("", "bare", "3")}
    assert {r.id for r in skipped.collect()} == {"3", "4"}
