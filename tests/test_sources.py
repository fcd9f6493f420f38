"""Sources, store, settings and streams on small files."""

import zipfile

import pytest

from loomwright import config
from loomwright.sources import files
from loomwright.sources.store import Store
from loomwright.streaming.ingest import ingest, text_stream


def test_text_and_router(spark, tmp_path):
    (tmp_path / "a.txt").write_text("4.1 Weld Repair\n1. Grind it\n\n2. Clean it\n")
    rows = files.read_any(spark, str(tmp_path / "a.txt")).orderBy("unit_no").collect()
    assert [(r.unit_type, r.section, r.paragraph) for r in rows] == [("heading", "4.1 Weld Repair", None), ("step", "4.1 Weld Repair", 1), ("step", "4.1 Weld Repair", 2)]
    with pytest.raises(FileNotFoundError):
        files.read_any(spark, str(tmp_path / "no.txt"))
    (tmp_path / "a.xls").write_text("")
    with pytest.raises(ValueError):
        files.read_any(spark, str(tmp_path / "a.xls"))


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def p(text, style=""):
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'

    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "m.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Intro.', 'Heading1')}{p('Page 3')}{p('1. Grind it')}{table}</w:body></w:document>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    rows = files.read_docx(spark, str(tmp_path)).orderBy("unit_no").collect()
    assert [(r.text, r.unit_type, r.page) for r in rows] == [("Intro.", "heading", 1), ("1. Grind it", "step", 3), ("a | b", "table", 3)]


def test_pdf_headings(spark):
    spans = spark.createDataFrame([("d", 1, 0, 0, "body text here.", 10.0), ("d", 1, 1, 0, "Big one.", 14.0), ("d", 1, 2, 0, "more body.", 10.0)], "document_id string, page int, block int, line int, text string, size double")
    assert [r.unit_type for r in files.pdf_units(spans).orderBy("unit_no").collect()] == ["heading", "paragraph", "paragraph"]


def test_store(spark, tmp_path):
    kind = "workflow_id string, document_id string, title_hint string, pages array<int>, nodes array<string>, edges array<string>, metadata map<string,string>"
    store = Store(spark, str(tmp_path / "store"))
    assert store.load() is None and store.clear() == 0
    store.save(spark.createDataFrame([("a", "d", "old", [1], ["n"], [], {}), ("b", "d", "t", [2, 1], [], [], {})], kind))
    store.save(spark.createDataFrame([("a", "d", "new", None, None, None, None)], kind))
    assert {r.workflow_id: r.title_hint for r in store.load().collect()} == {"a": "new", "b": "t"}
    assert {r.workflow_id: r.page_range for r in store.meta().collect()} == {"a": "", "b": "1–2"}
    store.delete(spark.createDataFrame([("a",)], "workflow_id string"))
    assert store.stats().first().workflows_found == 1 and store.clear() == 1 and store.load().count() == 0


def test_workflow_files(spark, tmp_path):
    (tmp_path / "wf_1.json").write_text('{"workflow_id": "wf_1", "pages": [1], "nodes": [{"node_id": "n", "order": 0}]}')
    (tmp_path / "wf_2.json").write_text("{broken")
    rows = files.read_workflows(spark, str(tmp_path)).collect()
    assert [(r.workflow_id, r.nodes[0].order, r.conditional_branches) for r in rows] == [("wf_1", 0, None)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1. Grind it\n2. Clean it\n")
    ingest(text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("retrieval: {top_k: 9}\n")
    pytest.importorskip("yaml")
    assert config.load(str(tmp_path / "s.yaml")).retrieval.top_k == 9
    assert config.load(values={"segmentation": {"threshold": 0.5}}).segmentation.threshold == 0.5
    with pytest.raises(ValueError):
        config.load(values={"no": 1})
