import json

import pytest

from millrace import api
from millrace.operators import planning as pl
from millrace.operators import project as pj
from millrace.sources import records as rc


def answered(prompts):
    return [json.dumps({"description": p.split("\n")[0], "key_concepts": ["k"], "functions": [{"name": "f"}]}) for p in prompts]


@pytest.fixture
def root(tmp_path):
    for name, text in {"main.py": "from pkg import util\nimport os, numpy\n", "pkg/__init__.py": "", "pkg/util.py": "x = 1\n", "alone.py": "y = 2\n", "pkg/web.ts": "import './no'\n"}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    return tmp_path


def test_runs_after_one_another(spark, root):
    config = api.Config(str(root / "src"), str(root / "doc"), entry="main.py", scope="all", formats=("json", "markdown"))
    dry = api.analyze(spark, config, answered, dry=True)
    assert dry.figures["files_unattempted"] == 4 and not rc.exists(spark, config.path("json"))
    first = api.analyze(spark, config, answered)
    assert (first.figures["files_documented_by_llm"], first.figures["files_skipped_insufficient_source"], first.figures["files_failed"]) == (4, 1, 0)
    rows = {r.path: r for r in first.files.collect()}
    assert rows["main.py"].description == "File: main.py" and rows["main.py"].links.sdk_dependencies == ["os"] and rows["main.py"].links.external_dependencies == ["numpy"]
    assert rows["main.py"].links.internal_dependencies == ["pkg/__init__.py"] and not rows["alone.py"].reachable_from_entry
    text = pj.read_text(spark, config.path("json")).first().text
    document = json.loads(text)
    assert list(document) == ["last_run", "folders", "dependency_graph", "files"] and [f["path"] for f in document["files"]] == ["alone.py", "main.py", "pkg/util.py", "pkg/web.ts"]
    (root / "src" / "alone.py").write_text("y = 3\n")
    again = api.analyze(spark, config, answered)
    assert again.figures["files_documented_by_llm"] == 1
    assert (again.figures["files_reused_unchanged"], again.figures["files_reused_identical_content"]) == (2, 1)  # main.py depends on an empty file
    both = [sorted(map(str, df.collect())) for df in (rc.read_either(spark, config.path("json"), None), rc.read_either(spark, str(root / "none"), config.path("markdown")))]
    assert both[0] == both[1] and rc.read_either(spark, str(root / "none"), None) is None


def test_a_call_without_an_answer(spark, root):
    config = api.Config(str(root / "src"), str(root / "doc"), scope="all")
    result = api.analyze(spark, config, lambda prompts: ["no"] * len(prompts))
    assert result.figures["files_failed"] == 4 and result.files.count() == 0


def test_a_source_that_changes(spark):
    states = iter([1, 2, 3, 3])
    read = lambda: spark.createDataFrame([("a", str(next(states)))], "rel string, content string")
    assert pl.steady(read).first().content == "3"
    states = iter([1, 2, 3, 4])
    with pytest.raises(RuntimeError):
        pl.steady(read)


def test_settings_of_lists_in_mappings():
    defaults = {"map": {"a": ["x"], "b": ["y", "z"], "c": 1}}
    assert rc.resolved(defaults, {"map_add": {"a": ["w", "x"], "d": ["n"]}, "map_remove": {"b": ["y"]}}) == {"map": {"a": ["x", "w"], "b": ["z"], "c": 1, "d": ["n"]}}


def test_nodes_are_kept_by_file_and_node(spark):
    node = lambda rows: spark.createDataFrame(rows, "rel string, node_id string, v int")
    rows = rc.upserted(node([("a", "1", 1), ("a", "2", 1), ("b", "1", 1)]), node([("a", "2", 9), ("c", "1", 9)]), ["rel", "node_id"])
    assert sorted(map(tuple, rows.collect())) == [("a", "1", 1), ("a", "2", 9), ("b", "1", 1), ("c", "1", 9)]
    assert sorted(map(tuple, rc.discarded(rows, node([("a", "1", 0)]), "rel").collect())) == [("b", "1", 1), ("c", "1", 9)]
