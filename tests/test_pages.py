"""Page-table operators: long documents, skew, partition counts."""

import pytest
from pyspark.sql import functions as F

from blattwerk.operators import comparing, documents, ordering, pages as ops, requests

SCHEMA = "method string, document string, page int, content string, notes string, seconds double"


@pytest.fixture
def skewed(spark):
    """One document holds a third of all pages."""
    rows = [("m", "a/long.pdf", n, f"L{n}", "source_file=a/long.pdf", 0.5) for n in range(1, 41)]
    rows += [
        ("m", f"a-b/{d}.pdf", n, " " if n == 2 else f"{d}.{n}", f"source_file=a-b/{d}.pdf", 0.25)
        for d in range(40) for n in (1, 2)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_document(rows):
    return {r.document: r for r in rows}


@pytest.mark.parametrize("per_block", [1024, 7, 1])
def test_one_text_per_document_whatever_its_length(skewed, monkeypatch, per_block):
    monkeypatch.setattr(ops, "PAGES_PER_BLOCK", per_block)
    texts = {r.document: (r.pages, r.seconds, r.text) for r in ops.document_text(skewed).collect()}
    assert len(texts) == 41
    assert texts["a/long.pdf"] == (40, 20.0, "\n\n".join(f"L{n}" for n in range(1, 41)))
    assert texts["a-b/3.pdf"] == (2, 0.5, "3.1")


def test_very_long_text_is_asked_whole(spark):
    pages = spark.range(1, 3001).selectExpr("'m' AS method", "'d' AS document", "int(id) AS page", "repeat(char(97 + id % 26), 3000) AS content")
    (row,) = requests.property_requests(ops.document_text(pages)).collect()
    assert row.text == "\n\n".join(chr(97 + n % 26) * 3000 for n in range(1, 3001))
    assert row.request.prompt.endswith(row.text)


@pytest.mark.parametrize("per_block", [1024, 7])
def test_numbers_in_document_do_not_depend_on_blocks(skewed, monkeypatch, per_block):
    monkeypatch.setattr(ops, "PAGES_PER_BLOCK", per_block)
    gaps = skewed.where("page % 3 <> 0")
    numbered = ops.number_pages_in_document(gaps).where("document = 'a/long.pdf'").orderBy("page").collect()
    assert [r.number for r in numbered] == list(range(1, 28))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_running_numbers_do_not_depend_on_partitions(spark, skewed, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = ops.number_pages_global(skewed.repartition(partitions)).orderBy("slide_number").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r.slide_number for r in rows] == list(range(1, 121))
    expected = sorted(((r.document.split("/"), r.page) for r in rows))
    assert [(r.document.split("/"), r.page) for r in rows] == expected
    assert rows[0].document == "a/long.pdf"


def test_running_total_starts_again_by_group(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    found = ordering.running_total(rows, F.col("id"), F.col("id"), "total", by="g").collect()
    assert all(r.total == sum(i for i in range(r.id + 1) if i % 3 == r.g) for r in found) and len(found) == 100


def test_pdf_titles(spark):
    rows = spark.createDataFrame([("m", "x/stem.pdf", n, "", "", 0.0) for n in range(1, 1001)], SCHEMA)
    titles = {r.page: r.title for r in ops.pdf_records(rows).collect()}
    assert titles[7] == "stem_page_007" and titles[1000] == "stem_page_1000"


def test_no_numbers_select_every_page(skewed):
    assert ops.select_pages(skewed, []).count() == skewed.count()
    assert ops.select_pages(skewed, [2, 3]).count() == 42


def test_page_filter_reaches_the_scan(spark, skewed, tmp_path):
    skewed.write.parquet(f"{tmp_path}/pages")
    chosen = ops.select_pages(spark.read.parquet(f"{tmp_path}/pages"), [2])
    plan = requests.rewrite_requests(chosen, F.lit("powerpoint"))
    assert "EqualTo(page,2)" in plan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_sources_with_one_name_stay_apart(spark):
    rows = spark.createDataFrame(
        [("m", "d", 1, "", "source_file=a/x.pdf", 0.0), ("m", "d", 2, "", "source_file=b/x.pdf", 0.0),
         ("m", "d", 3, "", "", 0.0), ("m", "d", 4, "", "source_file=a/x.pdf", 0.0)],
        SCHEMA,
    )
    found = [tuple(r) for r in ops.sources(rows).orderBy("first_page").select("name", "first_page", "pages").collect()]
    assert found == [("x.pdf", 1, 2), ("x.pdf", 2, 1), ("unbekanntes_dokument", 3, 1)]


def test_preview(spark):
    rows = spark.createDataFrame([("m", "d", n, "a\nb" + "x" * 300, "", 0.0) for n in range(1, 6)], SCHEMA)
    shown = ops.preview_pages(rows).orderBy("place").collect()
    assert [(r.page, r.chars, len(r.preview), r.preview[:4]) for r in shown] == [(n, 303, 200, "a bx") for n in (1, 2, 3)]
    assert ops.more_pages(rows).head().more == 2


def test_batch_time(spark, skewed):
    timed = ops.batch_time_share(skewed.withColumn("batch", F.col("document")).withColumn("batch_seconds", F.lit(10.0)))
    assert timed.where("document = 'a/long.pdf'").head().seconds == 0.25
    assert timed.count() == skewed.count()


def test_stored_tokens_or_estimate(spark):
    rows = spark.createDataFrame([("glm", "12345678", 0, 1.0), ("glm", "x", 9, 2.0)],
                                 "method string, content string, tokens long, seconds double")
    row = comparing.method_summary(rows).head()
    assert (row.total_tokens_estimate, row.total_chars, row.avg_time_per_slide) == (11, 9, 1.5)


def test_method_without_pages(spark):
    rows = spark.createDataFrame([("glm-ocr/x/free", "a", 1, 1.0)],
                                 "method string, content string, tokens long, seconds double")
    totals = comparing.empty_method_totals(comparing.method_totals(rows), ["deepseek", "glm"])
    found = {r.method: (r.total_slides, r.avg_time_per_slide) for r in totals.collect()}
    assert found == {"glm-ocr/x/free": (1, 1.0), "deepseek-ocr2": (0, 0.0)}


def test_markdown(skewed):
    row = by_document(documents.pages_markdown(skewed, "OCR").collect())["a-b/1.pdf"]
    assert row.markdown == "# 1.pdf (OCR)\n\n## Page 1\n\n1.1\n\n## Page 2\n\n_(kein Text erkannt)_\n"


def test_benchmark_report_text(spark):
    rows = spark.createDataFrame(
        [("glm-ocr/glm-ocr/structured", "d", n, "Text\nzwei", 0, 0.5) for n in range(1, 5)],
        "method string, document string, page int, content string, tokens long, seconds double",
    )
    lines = comparing.benchmark_report(comparing.method_totals(rows), rows).orderBy(*comparing.REPORT_ORDER)
    preview = "".join(f"**Slide {n}** (9 Zeichen):\n> Text zwei...\n\n" for n in (1, 2, 3))
    assert "\n".join(r.line for r in lines.collect()) == (
        "# Benchmark-Report: Dokumentenextraktion\n\n## Zusammenfassung\n\n"
        "| Methode | Slides | Zeit (s) | ø/Slide (s) | Zeichen | Tokens | Kosten (USD) | GPU |\n"
        "|---------|--------|----------|-------------|---------|--------|--------------|-----|\n"
        "| glm-ocr/glm-ocr/structured | 4 | 2.00 | 0.500 | 36 | 8 | lokal | ✓ |\n"
        "\n## Details pro Methode\n\n### glm-ocr/glm-ocr/structured\n\n"
        "- **Notizen**: Lokal gehostetes Vision-OCR (OpenAI-kompatibler Endpoint), Modus: structured\n"
        "- **Gesamtzeit**: 2.00s\n- **Durchsatz**: 0.500s/Slide\n\n" + preview + "*... und 1 weitere Slides*\n"
    )
