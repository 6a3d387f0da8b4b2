import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import planning as pl
from millrace.operators import responses as rs
from millrace.plans import documents
from millrace.sources import files as fl
from millrace.sources import records as rc
from millrace.streaming import incremental as inc


def test_records_survive_json_and_markdown(spark, sf, tmp_path):
    records = documents.prior(spark, sf).withColumn("description", F.lit("with ``` and --> and \n\n### `x`")).withColumn("key_concepts", F.array(F.lit("a")))
    records = records.select("path", "hash", "language", "description", "key_concepts", *pl.IDENTITY)
    path = str(tmp_path / "records")
    rc.write_json(records, path)
    rc.write_json(records, path)  # its own output may be replaced
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(rc.read_json(spark, path)) == rows(records)
    assert rows(rc.from_markdown(rc.to_markdown(records))) == rows(records)


def test_foreign_and_old_records_are_refused(spark, tmp_path):
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x.json").write_text('{"other": 1}\n')
    one = spark.createDataFrame([("p",)], "path string")
    with pytest.raises(ValueError):
        rc.write_json(one, str(tmp_path / "foreign"))
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.json").write_text(json.dumps({"marker": rc.MARKER, "version": 0, "file": {"path": "p"}}) + "\n")
    with pytest.raises(Exception, match="not a record"):
        rc.read_json(spark, str(tmp_path / "old")).collect()


def test_markdown_without_the_embedded_view(spark):
    frame = spark.createDataFrame([("a.py", "### `a.py`\n\nWhat it does.\n")], "path string, markdown string")
    row = rc.from_markdown(frame).first()
    assert (row.path, row.description, row.hash) == ("a.py", "What it does.", None)


def test_settings():
    defaults = {"skip": ["a", "b"], "map": {"x": 1}, "most": 3, "flag": False}
    assert rc.resolved(defaults, {"skip_add": ["c", "a"], "skip_remove": ["b"], "map_add": {"y": 2}, "map_remove": ["x"], "most": 4}) == {"skip": ["a", "c"], "map": {"y": 2}, "most": 4, "flag": False}
    for bad in ({"unknown": 1}, {"most": True}, {"flag": 1}):
        with pytest.raises(ValueError):
            rc.resolved(defaults, bad)


def test_scan_of_a_folder(spark, tmp_path):
    for name, body in {"src/a.py": b"import os\r\n", "src/.git/b.py": b"", "node_modules/c.js": b"", "Docs/d.py": b"", "e.txt": b"", "big.py": b"x" * 3000, "src/f.TSX": b"\xef\xbb\xbfx"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = {r.rel: r for r in fl.read_files(spark, str(tmp_path), ignored=("docs",), most_kb=2).collect()}
    assert set(rows) == {"src/a.py", "src/f.TSX"}
    assert rows["src/a.py"].content == "import os\n" and rows["src/f.TSX"].language == "tsx" and rows["src/f.TSX"].content == "x"


def test_scan_opens_only_what_it_keeps(spark, tmp_path):
    for name in ("pkg/__init__.py", "pkg/_own.py", "pkg/a.py", "node_modules/b.py", ".git/c.py", "docs/d.py", "pkg/deep/__init__.py", "pkg/skip.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    for name in ("node_modules/b.py", ".git/c.py", "docs/d.py"):  # opening these fails
        (tmp_path / name).unlink()
        (tmp_path / name).mkdir()
        (tmp_path / name / "e.py").mkdir()
    paths = [r.path for r in fl.listed(spark, str(tmp_path), ignored=("Docs",)).collect()]
    assert not [p for p in paths if "node_modules" in p or ".git" in p or "/docs/" in p]
    rows = {r.rel: r.content for r in fl.read_files(spark, str(tmp_path), ignored=("Docs",), excluded=("./pkg//skip.py",)).collect()}
    assert rows == {n: f"# {n}\n" for n in ("pkg/__init__.py", "pkg/_own.py", "pkg/a.py", "pkg/deep/__init__.py")}
    assert fl.read_files(spark, str(tmp_path / "pkg" / "deep")).count() == 1


def test_details_of_a_scan(spark):
    paths = spark.createDataFrame([(f"f{i:02}.txt", 5) for i in range(30)] + [("big.py", 600_000), ("ok.py", 1)], "rel string, length long")
    rows = fl.scan_details(fl.scanned(paths), 4).collect()
    texts = sorted((r for r in rows if r.kind == "extension"), key=lambda r: r.rel)
    assert [r.rel for r in texts] == [f"f{i:02}.txt" for i in range(4)] and {(r.total, r.retained, r.omitted) for r in texts} == {(30, 4, 26)}
    inner = ",".join(f'"{hashlib.sha256(f"f{i:02}.txt".encode()).hexdigest()}"' for i in range(30))
    assert {r.digest for r in texts} == {hashlib.sha256(f"[{inner}]".encode()).hexdigest()}
    assert [(r.rel, r.observed, r.bound, r.total) for r in rows if r.kind == "too_large"] == [("big.py", 600_000, 512_000, 1)]


def test_entries(spark):
    files = spark.createDataFrame([("src/main.py",), ("app.py",)], "rel string")
    assert fl.entry(files, ("main.py", "app.py", "src/main.py")) == "app.py"
    assert fl.entry(files, (), "./src//main.py") == "src/main.py" and fl.entry(files, (), "no.py") is None
    for bad in ("/abs", "../x", "C:/x", "./C:x", "."):
        with pytest.raises(ValueError):
            fl.entry(files, (), bad)


def test_reuse_blocks_on_every_key(spark):
    run = pl.Run()
    files = spark.createDataFrame([("a.py", "python", "x = 1\n")], "rel string, language string, content string")
    record = pl.expected(files, run).select(F.col("rel").alias("path"), "hash", "language", *pl.IDENTITY)
    assert pl.plan(files, record, run).first().route == "unchanged"
    for key in ("hash", "language", "path", *pl.IDENTITY):
        assert pl.plan(files, record.withColumn(key, F.lit("other")), run).first().route == "agent", key
    absent = record.withColumn("prompt_profile_digest", F.lit(None).cast("string"))
    assert pl.plan(files, absent, run).first().route == "unchanged"
    assert pl.plan(files, record, pl.Run(forced=("a.py",))).first().route == "agent"
    blank = files.withColumn("content", F.lit("\ufeff \n"))
    assert pl.plan(blank, record, run).first().route == "skip"


def test_answers_are_bounded():
    answer = {"description": "d" * 900, "usage_example": "u" * 900, "key_concepts": [f"c{i}" * 10 for i in range(40)], "functions": [{"name": "f"}], "dependencies_analysis": {"warnings": ["w" * 50] * 20}}
    cut = rs.bounded_answer(json.loads(json.dumps(answer)), 1200)
    assert len(rs.canonical(cut)) <= 1200 and cut["functions"] == [{"name": "f"}] if "functions" in cut else True
    assert "dependencies_analysis" not in cut and cut["description"].startswith("d")
    assert rs.bounded_answer({"a": 1}, 1200) == {"a": 1}


def test_a_repeated_batch_doubles_nothing(spark, tmp_path):
    out = str(tmp_path / uuid.uuid4().hex)
    each = inc.changed_only(out)
    batch = lambda rows: spark.createDataFrame(rows, "rel string, seq long, hash string")
    each(batch([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")]), 0)
    for _ in range(2):
        each(batch([("a", 4, "z"), ("b", 5, "new")]), 1)
    rows = sorted((r.rel, r.seq, r.hash) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 3, "z"), ("b", 2, "y"), ("b", 5, "new")]
