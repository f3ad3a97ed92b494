"""Walks over folders, text files, and groups that hold most pages."""

import os

import pytest
from blattwerk import session
from blattwerk.operators import documents, pages as ops
from blattwerk.plans import runs
from blattwerk.sinks import row_files, writers
from blattwerk.sources import files, stores
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def below(folder, frame):
    return sorted(r.path.removeprefix(f"file:{folder}/") for r in frame.collect())


def real_files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for a in range(3):
        for b in range(4):
            folder = root / f"a{a}" / f"b {b}" / "tief"
            folder.mkdir(parents=True)
            (folder / f"x{a}{b}.PDF").write_bytes(b"x" * (a + b))
            (folder.parent / "ü.png").write_bytes(b"")
    (root / "leer").mkdir()
    (root / ".punkt.pdf").write_text("p")
    (root / "_unter").mkdir()
    (root / "_unter" / "u.docx").write_text("u")
    os.symlink(root / "a0", root / "verweis")
    os.symlink(root / "a0" / "b 0" / "ü.png", root / "zeiger.png")
    return root


def test_walk(spark, tree):
    found = files.list_files(spark, str(tree), recursive=True)
    want = sorted(str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file() and "verweis" not in str(p))
    assert below(tree, found) == want and len(want) == 27
    lengths = {r.path.rsplit("/", 1)[1]: r.length for r in found.where("path LIKE '%PDF'").collect()}
    assert lengths == {f"x{a}{b}.PDF": a + b for a in range(3) for b in range(4)}
    assert found.where("modificationTime < current_timestamp() - INTERVAL 1 DAY OR modificationTime IS NULL").count() == 0
    assert below(tree, files.list_files(spark, str(tree) + "/")) == [".punkt.pdf", "zeiger.png"]
    assert below(tree, files.list_files(spark, f"file://{tree}/leer")) == []
    assert runs.listed_documents(spark, str(tree), recursive=True).count() == 27


def test_walk_of_no_folder(spark, tree):
    with pytest.raises(FileNotFoundError, match="fehlt"):
        files.list_files(spark, str(tree / "fehlt"))
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tree / "_unter" / "u.docx"))


def test_listing_in_small_batches(spark, tmp_path):
    for n in range(25):
        (tmp_path / f"{n}.png").write_bytes(b"x")
    import pyarrow as pa

    batches = list(stores.listed(iter([pa.RecordBatch.from_arrays([pa.array([str(tmp_path)])], ["path"])]), most=10))
    assert [b.num_rows for b in batches] == [10, 10, 5]
    assert files.read_files(spark, str(tmp_path), [".png"]).count() == 25


def test_text_files(spark, tmp_path):
    rows = [("m/a.md", "eins\n"), ("m/sub/b.md", ""), ("../raus.md", "x"), ("file:/n/c.md", "ü"), ("d.md", None)]
    frame = spark.createDataFrame(rows, "name string, text string").repartition(3)
    notes = row_files.write_files(frame, str(tmp_path / "out"))
    want = {"m/a.md": "eins\n", "m/sub/b.md": "", "raus.md": "x", "n/c.md": "ü", "d.md": ""}
    assert {name: (tmp_path / "out" / name).read_text("utf-8") for name in real_files(tmp_path / "out")} == want
    assert {r.name: r.length for r in notes.collect()} == {name: len(text.encode()) for name, text in want.items()}
    row_files.write_files(spark.createDataFrame([("d.md", "neu")], "name string, text string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "d.md").read_text() == "neu" and len(real_files(tmp_path / "out")) == 5
    assert row_files.write_files(frame.limit(0), str(tmp_path / "none")).count() == 0


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select(F.concat("id", F.lit(".md")).alias("name"), F.col("id").alias("text"))
    with pytest.raises(ValueError, match="mehrere Texte"):
        row_files.write_files(rows.unionByName(rows.limit(1)), str(tmp_path / "twice"))
    with pytest.raises(PySparkException, match="kein Dateiname"):
        row_files.write_files(rows.withColumn("name", F.expr("nullif(name, '77.md')")), str(tmp_path / "fails"))
    for name in ("twice", "fails"):
        folder = tmp_path / name
        assert not folder.exists() or list(folder.iterdir()) == []


def page_rows(spark, count, notes):
    nothing = "CAST(array() AS array<struct<headers:array<string>,rows:array<array<string>>>>) AS tables"
    return spark.sql(
        f"SELECT m AS method, concat('d', id DIV 50) AS document, CAST(id % 50 + 1 AS INT) AS page, concat('T', id) AS title, "
        f"concat('text ', id) AS content, {nothing}, {notes} AS notes, CAST(array() AS array<string>) AS images_ocr, "
        f"'' AS vector_ready_text, 1D AS seconds, 1L AS tokens, id + 1 AS slide_number "
        f"FROM range({count}), (SELECT explode(array('m/1', 'm/2')) AS m)"
    )


def test_markdown_files(spark, tmp_path):
    rows = page_rows(spark, 120, "''").where("page <= 3")
    writers.write_pages_markdown(rows, str(tmp_path / "out"), "OCR")
    assert real_files(tmp_path / "out") == [f"m_{m}/d{d}.md" for m in (1, 2) for d in range(3)]
    lines = ["# d1 (OCR)", ""]
    for page in (1, 2, 3):
        lines += [f"## Page {page}", "", f"text {49 + page}", ""]
    assert (tmp_path / "out" / "m_2" / "d1.md").read_text("utf-8") == "\n".join(lines).strip() + "\n"


def test_vector_ready_text_of_each_method(spark, tmp_path):
    notes = "CASE WHEN id % 3 = 0 THEN 'source_file=in/c.pdf' WHEN id % 7 = 0 THEN 'source_file=b.pdf' ELSE '' END"
    rows = page_rows(spark, 200, notes).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_vector_ready(rows, str(tmp_path / "out"), "slide_number")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for n in range(200):
        groups.setdefault("c.pdf" if n % 3 == 0 else "b.pdf" if n % 7 == 0 else "unbekanntes_dokument", []).append(n)
    lines = ["# Vector-Ready Gesamttext", ""]
    for source, members in groups.items():
        lines += [f"## Dokument: {source}", ""]
        for n in members:
            lines += [f"### T{n}", "", f"text {n}", ""]
    for method in ("m_1", "m_2"):
        parts = sorted((tmp_path / "out" / f"method={method}").glob("part-*"))
        assert "".join(p.read_text("utf-8") for p in parts) == "\n".join(lines).strip() + "\n"
    assert len(list((tmp_path / "out").rglob("part-*"))) > 2


def test_a_source_with_most_pages_is_dealt_out(spark):
    """90 % of the pages name no source; without adaptive execution no task gets three times the usual share."""
    notes = "CASE WHEN id % 10 = 0 THEN concat('source_file=s', id DIV 50) ELSE '' END"
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in names}
    rows = page_rows(spark, 40_000, notes)
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        grouped = ops.group_pages_by_source(rows, "slide_number")
        sizes = sorted(r["count"] for r in grouped.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 16 and sizes[-1] < 3 * sizes[8]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    plain = rows.where("method = 'm/1'")
    first = {r.source: r.n for r in ops.with_source(plain).groupBy("source").agg(F.min("slide_number").alias("n")).collect()}
    found = grouped.where("method = 'm/1'").select("source", "first_page", "slide_number").collect()
    assert len(found) == 40_000 and all(first[r.source] == r.first_page for r in found)
    assert documents.vector_ready_blocks(plain, "slide_number").count() == 40_000 + len(first)


def test_intermediate_tables_are_cleared_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    other = tmp_path / "blattwerk" / "other-application" / "table"
    other.mkdir(parents=True)
    assert session.stage(spark.range(3), "three").count() == 3
    assert os.path.isdir(session.own_folder(spark))
    session.clear(spark)
    session.clear(spark)
    assert not os.path.exists(session.own_folder(spark)) and other.is_dir()
