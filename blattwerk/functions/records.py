"""Page records and tables as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blattwerk.functions.text import strip


def _nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def table_markdown(table: Column) -> Column:
    """Markdown of a table struct; rows are padded or cut to the column count."""
    headers, rows = table["headers"], table["rows"]
    has_headers = F.size(headers) > 0
    width = F.when(has_headers, F.size(headers)).otherwise(F.size(F.get(rows, F.lit(0))))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    body = F.transform(
        rows,
        lambda row: line(F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)),
    )
    rule = line(F.array_repeat(F.lit("---"), width))
    lines = F.when(has_headers, F.concat(F.array(line(headers), rule), body)).otherwise(body)
    empty = ~has_headers & (F.size(rows) <= 0)
    return F.when(empty, F.lit("")).otherwise(F.array_join(lines, "\n"))


def table_json(table: Column) -> Column:
    return F.to_json(F.struct(table["headers"].alias("headers"), table["rows"].alias("rows")))


def page_text(include_notes: bool = False) -> Column:
    """Text block of a page-table row."""
    head = F.concat(
        F.lit("=== Slide "),
        F.col("page").cast("string"),
        F.coalesce(F.concat(F.lit(": "), _nonempty(F.col("title"))), F.lit("")),
        F.lit(" ==="),
    )
    tables = F.filter(F.transform("tables", table_markdown), lambda text: text != "")
    images = F.transform(
        "images_ocr",
        lambda text, at: F.when(
            strip(text) != "",
            F.concat(F.lit("\n[Bild "), (at + 1).cast("string"), F.lit(" - OCR]\n"), strip(text)),
        ),
    )
    rewritten = strip(F.col("vector_ready_text"))
    parts = [
        head,
        _nonempty(F.col("content")),
        F.transform(tables, lambda text: F.concat(F.lit("\n[Tabelle]\n"), text)),
        images,
        F.concat(F.lit("\n[Vector-Ready Text]\n"), _nonempty(rewritten)),
    ]
    if include_notes:
        parts.append(F.concat(F.lit("\n[Speaker Notes]\n"), _nonempty(F.col("notes"))))
    return F.concat_ws("\n\n", *parts)


def page_record() -> Column:
    """JSON-shaped struct of a page-table row; null fields are left out when written."""

    def nonempty_list(name: str) -> Column:
        return F.when(F.size(name) > 0, F.col(name))

    meta = F.struct(
        F.col("method"),
        F.round("seconds", 3).alias("time_seconds"),
        F.col("tokens").alias("token_count"),
    )
    return F.struct(
        F.col("page").alias("slide_number"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        nonempty_list("tables").alias("tables"),
        _nonempty(F.col("notes")).alias("notes"),
        nonempty_list("images_ocr").alias("images_ocr"),
        _nonempty(F.col("vector_ready_text")).alias("vector_ready_text"),
        F.when(F.col("method") != "", meta).alias("_meta"),
    )


def page_json() -> Column:
    return F.to_json(page_record())
