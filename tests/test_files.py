"""Folders, decks, records, ground truth and whole runs on real files."""

import io
import json
import random
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blattwerk.operators import comparing
from blattwerk.operators.engine import Engine
from blattwerk.plans import runs
from blattwerk.sinks import writers
from blattwerk.sources import decks, files, records
from catalog import decks as made


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.PDF", "a.png", "c.txt", "sub/d.docx", "e.gif"):
        (tmp_path / name).write_bytes(b"x")
    return tmp_path


def names(frame):
    return [r.path.rsplit("/", 1)[-1] for r in frame.collect()]


def test_listing(spark, folder):
    assert names(runs.listed_documents(spark, str(folder))) == ["a.png", "b.PDF", "e.gif"]
    assert names(runs.listed_documents(spark, str(folder), recursive=True)) == ["a.png", "b.PDF", "e.gif", "d.docx"]
    listing = files.list_files(spark, str(folder))
    assert names(files.invoice_files(listing)) == ["b.PDF"]
    assert names(files.handwriting_files(listing)) == ["a.png"]
    counts = files.file_counts(listing).head()
    assert (counts.images, counts.pdfs) == (1, 1)


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        runs.listed_documents(spark, str(tmp_path))


def test_listing_opens_no_file(spark, folder):
    plan = files.supported_documents(files.list_files(spark, str(folder)))._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_decks(spark, tmp_path):
    (tmp_path / "b.pptx").write_bytes(
        made.deck(
            [
                [made.shape([" Eins "], "<p:ph type='ctrTitle'/>"), made.shape(["a", " ", " b "]),
                 made.group(made.shape(["in"]), made.table([[["k"], ["v"]], [["1", "", " 2 "], [""]]]))],
                [made.table([[["nur"]]])],
                [],
            ],
            {2: ["Notiz", "zwei"]},
        )
    )
    (tmp_path / "kaputt.PPTX").write_bytes(b"kein Archiv")
    pages = runs.direct(spark, str(tmp_path), include_notes=True)
    good = {r.page: r for r in pages.where("error IS NULL").collect()}
    assert [good[n].title for n in (1, 2, 3)] == ["Eins", "", ""]
    assert good[1].content == "a\nb\nin" and good[2].content == "" and good[1].tokens == 1
    assert [(t.headers, t.rows) for t in good[1].tables] == [(["k", "v"], [["1\n2", ""]])]
    assert [(t.headers, t.rows) for t in good[2].tables] == [([], [["nur"]])]
    assert (good[1].notes, good[2].notes) == ("", "Notiz\nzwei")
    bad = pages.where("error IS NOT NULL").head()
    assert bad.document.endswith("kaputt.PPTX") and bad.error.startswith("BadZipFile")
    assert runs.direct(spark, str(tmp_path), [2, 3]).where("error IS NULL").count() == 2
    assert runs.direct(spark, str(tmp_path)).where("page = 2").head().notes == ""


def test_a_broken_slide_keeps_the_others(spark, tmp_path):
    whole = made.deck([[made.shape([f"Text {n}"])] for n in range(1, 5)])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            # Files are listed in the opposite order, so the third file is the second slide.
            new.writestr(name, "<kaputt" if name.endswith("slides/slide3.xml") else old.read(name))
    (tmp_path / "a.pptx").write_bytes(out.getvalue())
    rows = {r.page: r for r in runs.direct(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[2].error.startswith("ParseError") and [rows[n].content for n in (1, 3, 4)] == ["Text 1", "Text 3", "Text 4"]
    assert [r.page for r in runs.direct(spark, str(tmp_path), [3]).collect()] == [3]


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    read_bytes = 0

    def read(self, size=-1):
        data = super().read(size)
        self.read_bytes += len(data)
        return data


def with_media(whole, size):
    """The deck with a media file of random bytes before everything else."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as new:
        new.writestr("ppt/media/film.mp4", random.Random(1).randbytes(size))
        for name in old.namelist():
            new.writestr(name, old.read(name))
    return out.getvalue()


def test_many_small_decks_share_a_task(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"{n}.pptx").write_bytes(made.deck([[made.shape([f"Text {n}"])], [made.shape(["Ende"])]]))
    (tmp_path / "kaputt.pptx").write_bytes(b"kaputt")
    pages = decks.file_slides(files.list_files(spark, str(tmp_path)))
    assert pages.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    rows = pages.collect()
    assert len(rows) == 401 and sum(r.error is not None for r in rows) == 1
    assert {(r.document.rsplit("/", 1)[-1], r.page, *r.texts) for r in rows if r.error is None} == {
        (f"{n}.pptx", page, text) for n in range(200) for page, text in ((1, f"Text {n}"), (2, "Ende"))
    }


def test_decks_are_built_few_at_a_time():
    frame = pd.DataFrame({"conv_id": range(1000), "turn": 0, "role": "user", "text": "Text"})
    parts = list(made.built([frame, frame[:0]]))
    assert max(map(len, parts)) <= made.DECKS_PER_BATCH
    whole = pd.concat(parts, ignore_index=True)
    assert list(whole.path) == [f"in/deck{n}_0.pptx" for n in range(1000)]
    assert [slide["texts"][0] for slide in decks._slides(whole.content[7], None)] == ["Text", "Ende"]
    large = pd.DataFrame({"conv_id": range(4), "turn": 0, "role": "user", "text": random.Random(1).randbytes(2 << 20).hex()})
    assert [len(part) for part in made.built([large])] == [2, 2]


def test_slides_go_back_by_size(spark, monkeypatch):
    class Batches:
        def select(self, *names):
            return self

        def mapInArrow(self, unpack, schema):  # noqa: N802
            return unpack

    monkeypatch.setattr(decks, "CHARACTERS_PER_BATCH", 1000)
    one = made.deck([[made.shape(["x" * 600])], [made.shape(["y" * 600])], [made.shape(["z"])]])
    given = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [one, one]})
    assert [b.num_rows for b in decks.raw_slides(Batches())([given])] == [2, 3, 1]


def test_a_deck_is_read_by_ranges(spark, tmp_path):
    slides = [[made.shape([f"Text {n}"])] for n in range(1, 301)]
    whole = with_media(made.deck(slides), 20_000_000)
    file = Counted(whole)
    found = decks.listed_slides(file, None)
    assert [page for page, _ in found] == list(range(1, 301)) and file.read_bytes < 200_000
    file = Counted(whole)
    assert [s["texts"] for s in decks.slides_at(file, [1, 2], [part for _, part in found[:2]])] == [["Text 1"], ["Text 2"]]
    assert file.read_bytes < 200_000
    (tmp_path / "a.pptx").write_bytes(whole)
    (tmp_path / "b.pptx").write_bytes(made.deck([]))
    pages = runs.direct(spark, str(tmp_path))
    rows = pages.select("page", "content", "error", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.page, r.content) for r in rows) == [(n, f"Text {n}") for n in range(1, 301)]
    assert len({r.task for r in rows}) > 2 and all(r.error is None for r in rows)


def test_only_names_are_shuffled(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(made.deck([[]]))
    plan = decks.read_decks(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")


def test_extractions_of_one_array(spark, tmp_path):
    pages = [
        {"slide_number": 1, "title": "T", "content": "x"},
        {"slide_number": 2, "title": "", "content": "y", "tables": [{"headers": ["a"], "rows": [["1"]]}],
         "_meta": {"method": "direct", "time_seconds": 0.5, "token_count": 7}},
    ]
    (tmp_path / "p.json").write_text(json.dumps(pages, indent=2), encoding="utf-8")
    rows = records.read_extractions(spark, str(tmp_path / "p.json"), one_array=True).orderBy("page").collect()
    assert [(r.page, r.title, r.content, r.method, r.seconds, r.tokens) for r in rows] == [
        (1, "T", "x", "", 0.0, 0), (2, "", "y", "direct", 0.5, 7),
    ]
    assert rows[1].tables[0].rows == [["1"]] and rows[0].tables == []


def test_ground_truth(spark, tmp_path):
    truth = {"a.pdf": {"Tags": ["x", " ", "y  z"], "Währung": None, "Gesamt Betrag": 12.50}, "b.pdf": {}}
    (tmp_path / "t.json").write_text(json.dumps(truth, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = records.read_ground_truth(spark, str(tmp_path / "t.json")).collect()
    assert {(r.file, r.key): r.value for r in rows} == {
        ("a.pdf", "Tags"): "x | y z", ("a.pdf", "Währung"): "", ("a.pdf", "Gesamt Betrag"): "12.5",
    }


def text_of(path):
    return "".join(p.read_text("utf-8") for p in sorted(path.rglob("part-*")))


def page_rows(spark):
    nothing = "CAST(array() AS array<struct<headers:array<string>,rows:array<array<string>>>>) AS tables"
    return spark.sql(
        f"SELECT 'm' AS method, d AS document, p AS page, concat('T', p) AS title, concat(d, p) AS content, {nothing}, "
        "concat('source_file=in/', d) AS notes, CAST(array() AS array<string>) AS images_ocr, '' AS vector_ready_text, "
        "1D AS seconds, 1L AS tokens FROM (SELECT explode(array('b', 'a')) AS d), (SELECT explode(array(1, 2)) AS p)"
    )


def test_written_text_is_one_ordered_text(spark, tmp_path):
    writers.write_pages_text(page_rows(spark), str(tmp_path / "out"))
    blocks = [f"=== Slide {p}: T{p} ===\n\n{d}{p}" for d in "ab" for p in (1, 2)]
    assert text_of(tmp_path / "out") == "\n\n---\n\n".join(blocks) + "\n"


def test_written_vector_ready_text(spark, tmp_path):
    rows = page_rows(spark).withColumn("page", F.col("page") + F.when(F.col("document") == "b", 10).otherwise(20))
    writers.write_vector_ready(rows, str(tmp_path / "out"))
    lines = ["# Vector-Ready Gesamttext", ""]
    for document in "ba":
        lines += [f"## Dokument: {document}", ""]
        for page in (1, 2):
            lines += [f"### T{page}", "", f"{document}{page}", ""]
    assert text_of(tmp_path / "out") == "\n".join(lines).strip() + "\n"


def reading():
    """Stand-in for a vision model: the image's own bytes are its text."""
    import base64

    return lambda asked: [base64.b64decode(r["image"].split(",")[1]).decode("utf-8") for r in asked]


def quoting():
    return lambda asked: ["> " + r["prompt"].rsplit("\n", 1)[-1] for r in asked]


def invoicing():
    return lambda asked: ['{"Belegnummer": "%s"}' % r["prompt"].rsplit("\n", 1)[-1] for r in asked]


READ, QUOTE, INVOICE = Engine("read", reading), Engine("quote", quoting), Engine("invoicing", invoicing)


@pytest.fixture
def images(spark, tmp_path):
    for name, content in {"b_page_001.png": "b1", "b_page_002.png": " ", "a.jpg": "# Kopf", "b_page_003.png": "b3"}.items():
        (tmp_path / name).write_text(content)
    found = files.read_files(spark, str(tmp_path), [".png", ".jpg"])
    return files.page_images(found).withColumn("document", F.substring_index("document", "/", -1))


def test_page_images(images):
    assert sorted((r.document, r.page) for r in images.collect()) == [("a.jpg", 1), ("b", 1), ("b", 2), ("b", 3)]


def test_page_images_know_their_source(spark):
    names = ["in/a.v2_page_1.png", "in/b_page_2.png", "in/b.pdf_page_1.png", "in/b.pptx_page_1.png", "in/scan_page_7.jpg", "x_page_1.png"]
    found = files.page_images(
        spark.createDataFrame([(n, n.encode()) for n in names], "path string, content binary"),
        spark.createDataFrame([("in/a.v2.pdf",), ("in/b.pdf",), ("in/b.pptx",), ("in/scan_page_7.jpg",), ("y/x.pdf",)], "path string"),
    )
    assert {bytes(r.content).decode(): (r.document, r.page) for r in found.collect()} == {
        "in/a.v2_page_1.png": ("in/a.v2.pdf", 1), "in/b_page_2.png": ("in/b", 2), "in/b.pdf_page_1.png": ("in/b.pdf", 1),
        "in/b.pptx_page_1.png": ("in/b.pptx", 1), "in/scan_page_7.jpg": ("in/scan_page_7.jpg", 1), "x_page_1.png": ("x", 1),
    }


def test_unknown_engine_kind_is_an_error(images):
    with pytest.raises(ValueError, match="abc"):
        runs.run_pages(images, READ, "abc", "slide")
    assert {r.method for r in runs.run_pages(images, READ, "easyocr", "free").collect()} == {"easyocr-local"}


def test_folder_run(images):
    rows = runs.folder_run(images, READ, QUOTE, provider="x", model="y").orderBy("slide_number").collect()
    assert {r.method for r in rows} == {"vision-x/y"}
    assert [(r.slide_number, r.title, r.content, r.vector_ready_text, r.notes) for r in rows] == [
        (1, "a.jpg / Seite 1", "# Kopf", "> # Kopf", "source_file=a.jpg"),
        (2, "b / Seite 1", "b1", "> b1", "source_file=b"),
        (3, "b / Seite 2", " ", "", "source_file=b"),
        (4, "b / Seite 3", "b3", "> b3", "source_file=b"),
    ]


def test_run_with_titles_and_chosen_pages(images):
    rows = runs.run_pages(images, READ, "vision", "slide", "v", numbers=[1], titles=True).collect()
    assert sorted((r.document, r.title) for r in rows) == [("a.jpg", "Kopf"), ("b", "")]


def test_runs_on_images_and_pdfs_number_their_pages(spark, images):
    single = images.where("content <> encode('b1', 'UTF-8')").select(
        F.concat(F.lit("in/"), "document", F.lit("-"), F.col("page"), F.lit(".png")).alias("document"), F.lit(1).alias("page"), "content"
    )
    rows = runs.run_pages(single, READ, "glm", "free", records="image").orderBy("page").collect()
    assert [(r.document, r.page, r.title, r.content) for r in rows] == [
        ("in/a.jpg-1.png", 1, "a.jpg-1", "# Kopf"), ("in/b-2.png", 2, "b-2", ""), ("in/b-3.png", 3, "b-3", "b3"),
    ]
    pages = images.where("page > 1").withColumn("document", F.concat("document", F.lit(".pdf")))
    rows = runs.run_pages(pages, READ, "deepseek", "free", records="pdf").orderBy("page").collect()
    assert [(r.document, r.page, r.title) for r in rows] == [("b.pdf", 1, "b_page_001"), ("b.pdf", 2, "b_page_002")]
    with pytest.raises(KeyError):
        runs.run_pages(pages, READ, "glm", "free", records="deck")


def test_benchmark_inputs_are_written(spark, tmp_path):
    rows = page_rows(spark)
    for kind, folder in (("deck", "file"), ("image", "images")):
        writers.write_benchmark_data(comparing.method_summary(rows), rows, str(tmp_path / kind), kind)
        assert sorted(r.path for r in spark.read.json(str(tmp_path / kind / folder)).collect()) == ["a", "b"]
    assert (tmp_path / "deck" / "slides").is_dir() and not (tmp_path / "image" / "slides").exists()


def test_invoice_run(spark, images, tmp_path):
    out = str(tmp_path / "run")
    items, summary = runs.invoice_run(images, READ, INVOICE, out, settings={"input_dir": "r"})
    written = {r.document: r for r in spark.read.parquet(f"{out}/items").collect()}
    assert written["b"].properties.Belegnummer == "b3" and written["b"].filled_properties == 1 and len(written) == 2
    header = spark.read.json(f"{out}/run").head()
    assert (header.total_files, header.avg_property_fill_ratio, header.task) == (2, 0.0588, "invoice_property_extraction")
    assert header.ocr.backend == "transformers" and header.input_dir == "r" and summary.head().total_files == 2


def test_local_benchmark(spark, images, tmp_path):
    truth = spark.createDataFrame(
        [("b.pdf", "Belegnummer", "B3"), ("b.pdf", "Währung", "x")], "file string, key string, value string"
    )
    images = files.page_images(
        images.select(F.when(F.col("document") == "b", F.concat(F.lit("in/b_page_00"), F.col("page"), F.lit(".png")))
                      .otherwise(F.concat(F.lit("in/"), F.col("document"))).alias("path"), "content"),
        spark.createDataFrame([("in/b.pdf",), ("in/a.jpg",)], "path string"),
    )
    result = runs.local_benchmark(
        images, images, {"deepseek": READ, "glm": READ}, QUOTE, INVOICE, truth, handwriting_dir="h", invoices_dir="r"
    )
    items = {(r.method, r.document): r for r in result.invoice_items.collect()}
    assert len(items) == 4
    assert items["glm", "in/b.pdf"].ocr_text == "b1\n\nb3" and items["glm", "in/b.pdf"].pages == 3
    assert (items["glm", "in/b.pdf"].evaluated_fields, items["glm", "in/b.pdf"].exact_matches) == (2, 1)
    assert items["deepseek", "in/a.jpg"].evaluated_fields is None
    assert {(r.method, r.total_items) for r in result.handwriting_summary.collect()} == {("deepseek", 4), ("glm", 4)}
    assert {(r.method, r.avg_property_fill_ratio) for r in result.invoice_summary.collect()} == {
        ("deepseek", 0.0588), ("glm", 0.0588),
    }
    lines = [r.line for r in result.report.collect()]
    assert "- Handschrift-Dateien: 2" in lines and "- Rechnungs-PDFs: 2" in lines
    assert {k.key: (k.pred, k.truth, k.exact_match) for k in items["glm", "in/b.pdf"].per_key} == {
        "Belegnummer": ("b3", "B3", True), "Währung": ("", "x", False),
    }
    assert result.header == {
        "inputs": {"handwriting_dir": "h", "invoices_dir": "r"}, "methods": ["deepseek", "glm"],
        "llm": {"provider": "openai", "model": "(default)"},
    }
    result.write(str(tmp_path / "bench"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "bench" / "inputs")).select("task", "path").collect())) == [
        (task, path) for task in ("handwriting", "invoices") for path in ("in/a.jpg", "in/b.pdf")
    ]
    assert json.loads(text_of(tmp_path / "bench" / "run")) == result.header


def test_methods_keep_the_asked_order(spark, images):
    result = runs.local_benchmark(images, images, {"deepseek": READ, "glm": READ}, QUOTE, INVOICE, methods=["glm", "deepseek"])
    rows = result.report.orderBy(*comparing.REPORT_ORDER).collect()
    assert [r.method for r in rows if r.section == 3] == ["glm", "deepseek"] and result.header["methods"] == ["glm", "deepseek"]


def test_unknown_method_is_an_error():
    with pytest.raises(ValueError, match="abc, vision"):
        runs.check_methods(["glm", "vision", "abc"])
    assert runs.check_methods(None) == ["deepseek", "glm"]
    assert runs.check_methods(["glm", "glm"]) == ["glm"]


def test_benchmark(images):
    pages = runs.run_pages(images, READ, "glm", "structured")
    summary, report = runs.benchmark(pages)
    assert {(r.method, r.total_slides) for r in summary.collect()} == {
        ("glm-ocr/glm-ocr/structured", 4), ("deepseek-ocr2", 0),
    }
    assert any("1 weitere Slides" in r.line for r in report.collect())
