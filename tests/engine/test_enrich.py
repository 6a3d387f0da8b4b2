import json
import os
import uuid

import pytest

from millrace.operators import enrich as en


@pytest.fixture
def counted(tmp_path):
    """A function that leaves a file for every prompt it is paid for, and the number of these files."""
    folder = str(tmp_path)

    def complete(prompts):
        for p in prompts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(p)
        return ["no object" if p.startswith("bad") else json.dumps({"said": p}) for p in prompts]

    return complete, lambda: len(os.listdir(folder))


def test_one_chunk_is_one_call(spark, counted):
    complete, calls = counted
    rows = en.reduced(spark.createDataFrame([("a", 0, "only")], "rel string, ord int, prompt string"), complete)
    assert [json.loads(r.body) for r in rows.collect()] == [{"said": "only"}] and rows.count() == 1 and calls() == 1


def test_a_tree_of_calls(spark, counted):
    complete, calls = counted
    chunks = [("a", i, f"a{i}") for i in range(7)] + [("b", 0, "b0")]
    rows = {r.rel: r.body for r in en.reduced(spark.createDataFrame(chunks, "rel string, ord int, prompt string"), complete, width=3).collect()}
    leaf = lambda n: json.dumps({"said": f"a{n}"})
    joined = lambda xs: json.dumps({"said": "\n".join("- " + x for x in xs)})
    assert rows == {"a": joined([joined([leaf(0), leaf(1), leaf(2)]), joined([leaf(3), leaf(4), leaf(5)]), leaf(6)]), "b": json.dumps({"said": "b0"})}
    assert calls() == 8 + 2 + 1  # the seventh leaf goes up without a call


def test_answers_that_are_left_are_an_error(spark, counted):
    chunks = spark.createDataFrame([("a", i, str(i)) for i in range(9)], "rel string, ord int, prompt string")
    with pytest.raises(ValueError, match="left"):
        en.reduced(chunks, counted[0], width=2, levels=2)


def test_corrections_are_paid_once(spark, counted):
    complete, calls = counted
    rows = en.corrected(spark.createDataFrame([("good",), ("fine",)], "prompt string"), complete)
    assert sorted((r.attempts, json.loads(r.body)["said"]) for r in rows.collect()) == [(1, "fine"), (1, "good")] and rows.count() == 2 and calls() == 2
    bad = en.corrected(spark.createDataFrame([("bad",), ("good",)], "prompt string"), complete, lambda prompts: ['{"fixed": 1}' for _ in prompts])
    assert sorted((r.attempts, r.body) for r in bad.collect()) == [(1, '{"said": "good"}'), (2, '{"fixed": 1}')] and calls() == 4


def test_agents_are_paid_once(spark, counted):
    complete, calls = counted
    files = spark.createDataFrame([("a.py", "python", "x = 1"), ("b.py", "python", "y = 2")], "rel string, language string, content string")
    rows = en.agents(files, "triple", complete=complete)
    assert {(r.rel, r.agent) for r in rows.collect()} == {(f, a) for f in ("a.py", "b.py") for a in ("structure", "dependency", "documentation")}
    assert rows.count() == 6 and calls() == 6
    assert en.agents(files, complete=complete).count() == 2 and calls() == 8
