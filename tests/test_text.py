"""Text functions on edge rows."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from blattwerk import fixed
from blattwerk.functions import lookups, paths, records, text


@pytest.mark.parametrize(
    "given_text, title",
    [
        ("x\n# A \n**Titel**: B", "A"),
        ("**Titel: B**", "B"),
        ("**Titel**: Teil: 2**", "Teil: 2"),
        ("**Titel\n# A", ""),
        ("## A", ""),
        ("1. **Titel**: B", ""),
        ("# \n\xa0# Z\r", "Z"),
        ("#  \n**Titel**: B", "B"),
        ("", ""),
    ],
)
def test_markdown_title(one, given_text, title):
    assert one(text.markdown_title(F.lit(given_text))) == title


@pytest.mark.parametrize(
    "notes, source",
    [
        ("x\n source_file= /a/b.pdf \nsource_file=c", "/a/b.pdf"),
        ("source_file=", ""),
        ("x source_file=a", ""),
        ("a\x1dsource_file=q\x85r", "q"),
        (None, ""),
    ],
)
def test_source_from_notes(one, notes, source):
    assert one(text.source_from_notes(F.lit(notes).cast("string"))) == source


@pytest.mark.parametrize(
    "log, cleaned",
    [
        ("===\nBASE: 1\na\n\nPATCHES: 2\nb", "a\n\nb"),
        ("a\n \t \nb\r\n == \r\n=a", "a\n\nb\n=a"),
        ("==", ""),
        ("BASE: 1", ""),
        ("  a  \n  b", "a  \n  b"),
    ],
)
def test_clean_engine_log(one, log, cleaned):
    assert one(text.clean_engine_log(F.lit(log))) == cleaned


@pytest.mark.parametrize(
    "spec, numbers",
    [("1,3,5-10", [1, 3, 5, 6, 7, 8, 9, 10]), ("5-3", []), (" 2 , 2,1-2", [1, 2]), ("7", [7])],
)
def test_page_range(one, spec, numbers):
    assert one(text.page_range(F.lit(spec))) == numbers


@pytest.mark.parametrize("length, tokens", [(0, 1), (3, 1), (7, 1), (8, 2)])
def test_estimate_tokens(one, length, tokens):
    assert one(text.estimate_tokens(F.lit("ä" * length))) == tokens


@pytest.mark.parametrize(
    "rewritten, content, shown",
    [(" ", "x", fixed.NO_TEXT), ("", " x ", "x"), ("a", "x", "a"), ("", "", fixed.NO_TEXT)],
)
def test_fallback_text(one, rewritten, content, shown):
    assert one(text.fallback_text(F.lit(rewritten), F.lit(content), fixed.NO_TEXT)) == shown


def test_normalize_value(one):
    assert one(text.normalize_value(F.array(F.lit("a"), F.lit(" "), F.lit("b  c")), True)) == "a | b c"
    assert one(text.normalize_value(F.lit(None).cast("string"))) == ""


def test_white_space_is_the_unicode_set(one):
    every = "".join(chr(c) for c in range(1, 0xD800) if chr(c).isspace())
    assert one(text.strip(F.lit(every + "a b" + every))) == "a b"
    assert one(text.norm_space(F.lit(f"a{every}b{every}"))) == "a b"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0xD7FF, min_codepoint=1), max_size=20), min_size=1, max_size=50))
def test_strip_and_norm_agree_with_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(text.strip(F.col("t")), text.norm_space(F.col("t"))).collect()
    assert [tuple(row) for row in found] == [(t.strip(), " ".join(t.split())) for t in texts]


@pytest.mark.parametrize(
    "path, suffix, stem, kind",
    [
        ("a/b.tar.PDF", ".pdf", "b.tar", "pdf"),
        ("d.x/a", "", "a", "unsupported"),
        (".hidden", "", ".hidden", "unsupported"),
        ("x.Jpg", ".jpg", "x", "image"),
        ("q/x.docx", ".docx", "x", "office"),
    ],
)
def test_paths(one, path, suffix, stem, kind):
    column = F.lit(path)
    assert one(F.array(paths.suffix(column), paths.stem(column), paths.file_kind(column))) == [suffix, stem, kind]


def test_path_order(spark):
    rows = spark.createDataFrame([("a-b/c",), ("a/b",)], "path string")
    assert [r.path for r in rows.orderBy(paths.path_order(F.col("path"))).collect()] == ["a/b", "a-b/c"]


@pytest.mark.parametrize(
    "headers, rows, markdown",
    [
        (["a", "b"], [["1"], ["1", "2", "3"]], "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"),
        ([], [["q", "w"]], "| q | w |"),
        ([], [], ""),
    ],
)
def test_table_markdown(spark, headers, rows, markdown):
    schema = "t struct<headers:array<string>,rows:array<array<string>>>"
    frame = spark.createDataFrame([((headers, rows),)], schema)
    assert frame.select(records.table_markdown(F.col("t"))).head()[0] == markdown


def test_page_json_leaves_out_empty_fields(spark):
    row = spark.sql(
        "SELECT '' AS method, 3 AS page, '' AS title, 'x' AS content, '' AS notes, '' AS vector_ready_text, "
        "array() AS tables, CAST(array() AS array<string>) AS images_ocr, 0D AS seconds, 0L AS tokens"
    )
    assert row.select(records.page_json()).head()[0] == '{"slide_number":3,"title":"","content":"x"}'


def test_page_text_numbers_images(spark):
    row = spark.sql(
        "SELECT 3 AS page, 'T' AS title, '' AS content, 'N' AS notes, ' v ' AS vector_ready_text, "
        "CAST(array() AS array<struct<headers:array<string>,rows:array<array<string>>>>) AS tables, "
        "array(' ', ' a ') AS images_ocr"
    )
    assert row.select(records.page_text()).head()[0] == (
        "=== Slide 3: T ===\n\n\n[Bild 2 - OCR]\na\n\n\n[Vector-Ready Text]\nv"
    )
    assert row.select(records.page_text(include_notes=True)).head()[0].endswith("\n\n\n[Speaker Notes]\nN")


@pytest.mark.parametrize(
    "method, cost", [("deepseek-ocr2/vllm/free", 0.5), ("x/ocr", 0.25), ("other", 0.0)]
)
def test_cost(one, method, cost):
    assert one(lookups.cost_per_page(F.lit(method), {"deepseek-ocr2": 0.5, "ocr": 0.25})) == cost


def test_invalid_methods(one):
    asked = F.split(F.lit("glm,vision,abc,abc"), ",")
    assert one(lookups.invalid_methods(asked)) == ["abc", "vision"]


@pytest.mark.parametrize(
    "provider, model, resolved",
    [("anthropic", None, "claude-opus-4-5-20251101"), ("openai", "", "gpt-5.2"), ("x", "m", "m")],
)
def test_resolve_model(one, provider, model, resolved):
    assert one(lookups.resolve_model(F.lit(provider), F.lit(model).cast("string"))) == resolved
