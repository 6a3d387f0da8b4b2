import pytest
from pyspark.sql import functions as F

from millrace.operators import project as pj
from millrace.plans import project as plans
from millrace.plans import registry

RUN = {"entry_file": "a.py"}


def view(spark, paths, errors=""):
    files = spark.createDataFrame([(p, f"About {p}.\n\n#### x\r\n### a heading in a text", "python") for p in paths], "path string, description string, language string")
    catalog = spark.createDataFrame([(f"lib{i:02}", "external", f"use {i}", i) for i in range(30)] + [("### odd", "external", None, 1), ("## odd", "external", None, 2)], "name string, type string, used_for string, file_count long")
    edges = spark.createDataFrame([(a, b) for a, b in zip(paths, paths[1:], strict=False)], "from string, to string")
    return pj.View(files, None, catalog, edges, RUN, errors)


@pytest.mark.parametrize("errors", ["", "- `no` -> `edge`"])
def test_stored_documents_are_read_where_they_lie(spark, tmp_path, errors):
    paths = [f"d{i % 3}/f{i:03}.py" for i in range(60)]
    folder = str(tmp_path / "document")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pj.write(pj.markdown_blocks(view(spark, paths, errors)), folder)
        text = pj.read_text(spark, folder)
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(pj.catalog_of(pj.stored_chunks(spark, folder, "Dependency Catalog"))) == rows(pj.read_catalog(text))
        assert rows(pj.stored_edges(spark, folder)) == rows(pj.read_edges(text)) and pj.read_edges(text).count() == 59
        assert rows(pj.files_of(pj.stored_chunks(spark, folder, "Files"))) == rows(pj.read_files(text))
        assert not pj.stored_chunks(spark, folder, "Folder Map").count()
        assert pj.stored_chunks(spark, folder, "Run Summary").select(F.startswith("body", F.lit("- Files documented by LLM")).alias("b")).first().b
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["project_catalog_read", "project_edges_read", "project_markdown_read", "project_markdown_whole"])
def test_no_document_meets_in_one_row(spark, sf, monkeypatch, name):
    def whole(*_):
        raise AssertionError("the document was put into one row")

    monkeypatch.setattr(plans.pj, "read_text", whole)
    assert registry.QUERIES[name](spark, sf).count()
