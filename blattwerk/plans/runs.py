"""Runs from files or page images to records, properties and reports.

A model pass is the expensive step: its result is written once (``stage``) and
every later step reads that table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blattwerk import fixed
from blattwerk.functions import lookups, paths
from blattwerk.functions.text import estimate_tokens, markdown_title
from blattwerk.operators import comparing, invoices, pages as page_ops, requests, scoring
from blattwerk.operators.engine import Engine, apply_engine
from blattwerk.session import prepare, stage
from blattwerk.sinks import writers
from blattwerk.sources import decks, files

PAGE_KEY = ("method", "document", "page")


def direct(
    spark: SparkSession,
    folder: str,
    numbers: list[int] | None = None,
    include_notes: bool = False,
) -> DataFrame:
    """Page table of the decks in a folder, read from their XML.

    Written once: Spark takes what is read from a list of files for as small as the
    list, and might send it whole to every task of a later join.
    """
    prepare(spark)
    return stage(decks.read_decks(spark, folder, include_notes, numbers=numbers), "deck-pages")


def run_pages(
    images: DataFrame,
    engine: Engine,
    engine_kind: str,
    mode: str,
    label: str | None = None,
    numbers: list[int] | None = None,
    provider: str = "anthropic",
    model: str | None = None,
    titles: bool = False,
    replies: str | None = None,
    records: str | None = None,
) -> DataFrame:
    """Page table from page images ``(document, page, content)``.

    ``engine_kind`` is one of ``fixed.ENGINE_KINDS``; ``label`` replaces the
    usual method label of the records. Only the chosen pages reach the engine. Replies are
    written once; a failed page keeps its error. ``replies`` names a table of replies that
    later runs find again (see ``apply_engine``). ``records`` is ``pdf`` or ``image`` for
    runs on those, which number and title their pages themselves.
    """
    if engine_kind not in fixed.ENGINE_KINDS:
        raise ValueError(f"Unbekannte Engine: {engine_kind}")
    numbered = {None: lambda pages: pages, "pdf": page_ops.pdf_records, "image": page_ops.image_page_records}[records]
    prepare(images.sparkSession)
    chosen = page_ops.select_pages(images, numbers)
    settings = [F.lit(value).cast("string") for value in (engine_kind, provider, model, mode)]
    method = F.lit(label) if label else lookups.method_label(*settings)
    asked = requests.page_requests(
        chosen,
        F.lit(engine_kind),
        F.lit(mode),
        requests.image_payload(F.col("content")),
        F.lit(provider),
        F.lit(model).cast("string"),
    ).select(method.alias("method"), "document", "page", "request")
    answered = stage(apply_engine(asked, engine, strip=engine_kind == "glm", replies=replies), "page-replies")
    content = F.coalesce("reply", F.lit(""))
    found = answered.select(
        *PAGE_KEY,
        (markdown_title(content) if titles else F.lit("")).alias("title"),
        content.alias("content"),
        F.array().cast("array<struct<headers:array<string>, rows:array<array<string>>>>").alias("tables"),
        F.lit("").alias("notes"),
        F.array().cast("array<string>").alias("images_ocr"),
        F.lit("").alias("vector_ready_text"),
        F.col("reply_seconds").alias("seconds"),
        estimate_tokens(content).alias("tokens"),
        F.col("reply_error").alias("error"),
    )
    return numbered(found)


def vector_ready_pages(
    pages: DataFrame,
    engine: Engine | None,
    source_type: str | Column,
    provider: str = "openai",
    model: str | None = None,
    spread: bool = False,
    replies: str | None = None,
) -> DataFrame:
    """Pages with ``vector_ready_text`` and ``post_seconds`` from a second pass.

    Blank pages get the empty text without a call; no engine switches it off.
    A failed call leaves the empty text and a ``rewrite_error``.
    """
    if engine is None:
        return pages
    kind = source_type if isinstance(source_type, Column) else F.lit(source_type)
    resolved = lookups.resolve_model(F.lit(provider), F.lit(model).cast("string"))
    answered = apply_engine(
        requests.rewrite_requests(pages.drop("vector_ready_text"), kind, resolved),
        engine,
        spread_by=PAGE_KEY if spread else (),
        replies=replies,
    )
    return (
        answered.withColumn("vector_ready_text", F.coalesce("reply", F.lit("")))
        .withColumnsRenamed({"reply_seconds": "post_seconds", "reply_error": "rewrite_error"})
        .drop("reply")
    )


def folder_run(
    images: DataFrame,
    engine: Engine,
    rewriter: Engine | None = None,
    mode: str = "slide",
    provider: str = "anthropic",
    model: str | None = None,
) -> DataFrame:
    """Page images of a folder to running-numbered pages with rewritten text."""
    found = run_pages(images, engine, "vision", mode, provider=provider, model=model)
    recorded = page_ops.folder_records(found)
    rewritten = vector_ready_pages(recorded, rewriter, "powerpoint", spread=True)
    return stage(rewritten, "folder-pages") if rewriter else recorded


def invoice_properties(
    pages: DataFrame,
    engine: Engine,
    provider: str = "openai",
    model: str | None = None,
    replies: str | None = None,
) -> DataFrame:
    """One row per (method, document): text, properties, fill ratio, error.

    Page texts are joined, asked for properties, and the replies parsed. A
    document without text is not asked and has empty properties. The result is
    written once, so later filters and joins neither ask nor parse again.
    """
    resolved = lookups.resolve_model(F.lit(provider), F.lit(model).cast("string"))
    documents = page_ops.document_text(pages).withColumnRenamed("seconds", "page_seconds")
    answered = apply_engine(requests.property_requests(documents, resolved), engine, replies=replies)
    parsed = invoices.parse_replies(answered.withColumn("reply", F.coalesce("reply", F.lit(""))))
    error = F.coalesce("reply_error", "error")
    items = invoices.invoice_fill(
        parsed.withColumn("error", error)
        .withColumn("properties", F.when(error.isNull(), F.col("properties")))
        .withColumnRenamed("text", "ocr_text")
        .withColumn("seconds", F.col("page_seconds") + F.col("reply_seconds"))
        .drop("reply_error", "reply_seconds", "reply", "page_seconds")
    )
    return stage(items, "invoice-items")


def invoice_run(
    images: DataFrame,
    engine: Engine,
    property_engine: Engine,
    path: str,
    engine_kind: str = "deepseek",
    mode: str = "structured",
    backend: str | None = None,
    provider: str = "openai",
    model: str | None = None,
    settings: dict[str, object] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Invoices from page images to a written run: ``(items, summary)``.

    Pages are read, their texts joined and asked for properties; the items are
    written to ``path`` and the summary is taken from what was written. The
    header names the method, the task, both models and ``settings``.
    """
    pages = run_pages(images, engine, engine_kind, mode, model=backend)
    items = invoice_properties(pages, property_engine, provider, model)
    header = {
        "method": engine_kind,
        "task": "invoice_property_extraction",
        "llm": {"provider": provider, "model": model or "(default)"},
        "ocr": {"backend": backend or fixed.DEEPSEEK_BACKEND, "prompt_mode": mode},
        **(settings or {}),
    }
    return items, writers.write_invoice_run(items, path, header)


class LocalBenchmark(NamedTuple):
    """Tables of a two-task comparison of local engines."""

    handwriting_items: DataFrame
    handwriting_summary: DataFrame
    invoice_items: DataFrame
    invoice_summary: DataFrame
    report: DataFrame
    header: dict[str, object]
    inputs: DataFrame

    def write(self, path: str) -> None:
        """Items, summaries, inputs and header below ``path``."""
        writers.write_local_benchmark(
            (self.handwriting_items, self.handwriting_summary), (self.invoice_items, self.invoice_summary),
            path, self.header, self.inputs,
        )


def check_methods(methods: list[str] | None) -> list[str]:
    """The methods as asked, each once (all in the fixed order without any), or an error that names the invalid ones."""
    invalid = sorted(set(methods or []) - set(fixed.METHODS))
    if invalid:
        raise ValueError(f"Ungültige Methoden: {', '.join(invalid)}")
    return list(fixed.METHODS) if methods is None else list(dict.fromkeys(methods))


def local_benchmark(
    handwriting: DataFrame,
    invoice_pages: DataFrame,
    engines: dict[str, Engine],
    rewriter: Engine,
    property_engine: Engine,
    truth: DataFrame | None = None,
    methods: list[str] | None = None,
    handwriting_dir: str = "",
    invoices_dir: str = "",
    provider: str = "openai",
    model: str | None = None,
) -> LocalBenchmark:
    """Handwriting and invoices by every method, in the asked order, scored against ground truth.

    Both inputs are page images ``(document, page, content)``.
    """
    chosen = check_methods(methods)

    def by_method(images: DataFrame, mode: str) -> DataFrame:
        runs = [run_pages(images, engines[name], name, mode, name) for name in chosen]
        return page_ops.union_all(runs)

    rewritten = stage(
        vector_ready_pages(by_method(handwriting, "free"), rewriter, "handwriting", provider, model), "handwriting"
    )
    items = invoice_properties(by_method(invoice_pages, "structured"), property_engine, provider, model)
    if truth is not None:
        items = scoring.match_rate(
            scoring.truth_lookup(items, truth, paths.base_name(F.col("document")), F.col("document"))
        )
    handwriting_summary = comparing.handwriting_summary(rewritten)
    invoice_summary = invoices.invoice_method_summary(items)
    documents = page_ops.union_all(
        [
            images.select(F.lit(task).alias("task"), F.col("document").alias("path")).distinct()
            for task, images in (("handwriting", handwriting), ("invoices", invoice_pages))
        ]
    )
    counts = documents.agg(
        F.count_if(F.col("task") == "handwriting").alias("images"), F.count_if(F.col("task") == "invoices").alias("pdfs")
    )
    report = comparing.local_benchmark_report(
        handwriting_summary, invoice_summary, counts, handwriting_dir, invoices_dir, provider, model, chosen
    )
    header = {
        "inputs": {"handwriting_dir": handwriting_dir, "invoices_dir": invoices_dir},
        "methods": chosen,
        "llm": {"provider": provider, "model": model or "(default)"},
    }
    return LocalBenchmark(
        comparing.handwriting_items(rewritten), handwriting_summary, items, invoice_summary, report, header, documents
    )


def benchmark(
    pages: DataFrame, methods: list[str] | None = None, **settings: object
) -> tuple[DataFrame, DataFrame]:
    """``(summary, report lines)`` of page tables of one or more methods."""
    totals = comparing.empty_method_totals(
        comparing.method_totals(pages, **settings), check_methods(methods), **settings
    )
    return comparing.round_metrics(totals), comparing.benchmark_report(totals, pages)


def listed_documents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Supported files of a folder in path order; an error where there are none."""
    found = files.supported_documents(files.list_files(spark, folder, recursive))
    return files.sort_documents(
        files.require_rows(found, f"Keine unterstuetzten Dateien in {folder} gefunden.")
    )
