"""Page records put together as text and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blattwerk import fixed
from blattwerk.functions import paths, text
from blattwerk.functions.records import page_text
from blattwerk.operators.pages import group_pages_by_source, texts_in_order


def pages_text(pages: DataFrame, include_notes: bool = False) -> DataFrame:
    """Text form of each document, page blocks set apart by a rule."""
    found = texts_in_order(pages, page_text(include_notes), r"\n\n---\n\n")
    return found.select("method", "document", F.concat("text", F.lit("\n")).alias("text"))


def markdown_block(page: Column, content: Column) -> Column:
    body = text.strip(F.coalesce(content, F.lit("")))
    shown = F.when(body == "", F.lit(fixed.NO_PAGE_TEXT)).otherwise(body)
    return F.concat(F.lit("\n## Page "), page.cast("string"), F.lit("\n\n"), shown)


def pages_markdown(pages: DataFrame, engine_name: str) -> DataFrame:
    """Markdown form of each document: a title and its pages in order."""
    title = F.concat(
        F.lit("# "), paths.base_name(F.col("document")), F.lit(f" ({engine_name})"), F.lit("\n")
    )
    found = texts_in_order(pages, markdown_block(F.col("page"), F.col("content")), r"\n")
    return found.select("method", "document", F.concat(title, F.col("text"), F.lit("\n")).alias("markdown"))


VECTOR_READY_ORDER = ["method", "first_page", "source", "page"]


def vector_ready_blocks(pages: DataFrame, number: str = "page") -> DataFrame:
    """Markdown of all rewritten texts of a run, as ordered blocks per method.

    One block per page and one per source. The whole is one text for the whole
    run, so it is never put together in one place: sorted by
    ``VECTOR_READY_ORDER`` and written line by line, the blocks are its file.
    """
    grouped = group_pages_by_source(pages, number)
    shown = text.fallback_text(F.col("vector_ready_text"), F.col("content"), fixed.NO_TEXT)
    page_block = F.concat(
        F.lit("\n### "), text.page_label(F.col("title"), F.col(number)), F.lit("\n\n"), shown
    )
    heading = F.concat(F.lit("\n## Dokument: "), F.col("name"))
    nothing = F.lit(None).cast(pages.schema[number].dataType)
    # The first page of a group brings its heading along.
    blocks = F.when(
        F.col(number) == F.col("first_page"),
        F.array(F.struct(nothing.alias("page"), heading.alias("block")), F.struct(F.col(number).alias("page"), page_block.alias("block"))),
    ).otherwise(F.array(F.struct(F.col(number).alias("page"), page_block.alias("block"))))
    return grouped.select("method", "first_page", "source", F.inline(blocks))
