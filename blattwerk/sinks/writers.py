"""Writers of page tables, texts, runs and reports.

All of them write in parallel. Texts that are one file for a whole run are
range-sorted first, so their part files, read in name order, are that text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from blattwerk import fixed
from blattwerk.functions import paths
from blattwerk.functions.records import page_record, page_text
from blattwerk.operators.comparing import REPORT_ORDER
from blattwerk.operators.documents import VECTOR_READY_ORDER, pages_markdown, vector_ready_blocks
from blattwerk.operators.invoices import invoice_run_summary
from blattwerk.sinks.row_files import write_files


def write_pages_json(pages: DataFrame, path: str) -> None:
    """Page records as JSON lines, with the document they belong to."""
    pages.select("document", page_record().alias("r")).select("document", "r.*").write.json(path)


def write_pages_text(pages: DataFrame, path: str, include_notes: bool = False) -> None:
    """Text blocks of a run in (document, page) order, set apart by a rule."""
    order = [paths.path_order(F.col("document")), F.col("page"), F.col("method")]
    first = pages.agg(F.min(F.struct(order[0], "page", "method", "document"))).head()[0]
    block = page_text(include_notes)
    if first is not None:
        opening = F.lit(True)
        for name in ("document", "page", "method"):
            opening = opening & (F.col(name) == F.lit(first[name]))
        block = F.when(opening, block).otherwise(F.concat(F.lit("\n---\n\n"), block))
    pages.withColumn("block", block).orderBy(*order).select("block").write.text(path)


def method_folder(method: Column) -> Column:
    """Name of a folder for a method label."""
    return F.replace(method, F.lit("/"), F.lit("_"))


def write_pages_markdown(pages: DataFrame, path: str, engine_name: str) -> DataFrame:
    """One Markdown file ``<method>/<document>.md`` per document; returns ``(name, length)``."""
    name = F.concat(method_folder(F.col("method")), F.lit("/"), F.col("document"), F.lit(".md"))
    found = pages_markdown(pages, engine_name).select(name.alias("name"), F.col("markdown").alias("text"))
    return write_files(found, path)


def write_vector_ready(pages: DataFrame, path: str, number: str = "page") -> None:
    """The Markdown of all rewritten texts, a folder ``method=<method>`` per method.

    Part files of a folder, read in name order, are that method's text: blocks are
    sorted by range over many tasks, and the heading is a block before all others.
    """
    blocks = vector_ready_blocks(pages, number)
    kinds = {field.name: field.dataType for field in blocks.schema.fields}
    nothing = [F.lit(None).cast(kinds[name]).alias(name) for name in VECTOR_READY_ORDER[1:]]
    heading = pages.select("method").distinct().select("method", *nothing, F.lit(fixed.VECTOR_READY_HEADING).alias("block"))
    ordered = blocks.unionByName(heading).withColumn("method", method_folder(F.col("method")))
    ordered.orderBy(*VECTOR_READY_ORDER).select("method", "block").write.partitionBy("method").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A report of a few lines per method, as one text file."""
    lines.orderBy(*REPORT_ORDER).select("line").coalesce(1).write.text(path)


def write_invoice_run(items: DataFrame, path: str, settings: dict[str, object]) -> DataFrame:
    """Items as Parquet and a one-row header as JSON; credentials are no setting.

    The header's summary is taken from the items as written, and returned.
    """
    items.write.parquet(f"{path}/items")
    written = items.sparkSession.read.schema(items.schema).parquet(f"{path}/items")
    header = summary = invoice_run_summary(written)
    for name, value in settings.items():
        group = value if isinstance(value, dict) else None
        column = (
            F.lit(value)
            if group is None
            else F.struct(*[F.lit(inner).alias(key) for key, inner in group.items()])
        )
        header = header.withColumn(name, column)
    header.coalesce(1).write.json(f"{path}/run")
    return summary


def write_benchmark_data(
    summary: DataFrame, pages: DataFrame, path: str, input_kind: str = "deck", inputs: DataFrame | None = None
) -> None:
    """Results per method, the input files and, but for images, the page records of each method.

    ``inputs`` are the files as ``path``; without them, the documents of the pages. Their
    folder is ``images`` or ``file``, after the kind of input.
    """
    if inputs is None:
        inputs = pages.select(F.col("document").alias("path")).distinct()
    inputs.select("path").write.json(f"{path}/{'images' if input_kind == 'image' else 'file'}")
    summary.coalesce(1).write.json(f"{path}/results")
    folder = {"deck": "slides", "pdf": "pages"}.get(input_kind)
    if folder:
        pages.select(
            F.col("method").alias("by_method"), "document", page_record().alias("r")
        ).select("by_method", "document", "r.*").write.partitionBy("by_method").json(f"{path}/{folder}")


def write_local_benchmark(
    handwriting: tuple[DataFrame, DataFrame],
    invoices: tuple[DataFrame, DataFrame],
    path: str,
    header: dict[str, object],
    inputs: DataFrame,
) -> None:
    """Items and summary of both tasks, one folder per task and method, and what they were made from.

    ``header`` (folders, methods, text model) is one JSON line; ``inputs`` are the files
    of each task as ``(task, path)``.
    """
    for task, (items, summary) in {"handwriting": handwriting, "invoices": invoices}.items():
        items.write.partitionBy("method").parquet(f"{path}/items/task={task}")
        summary.coalesce(1).write.json(f"{path}/summary/task={task}")
    inputs.write.partitionBy("task").parquet(f"{path}/inputs")
    line = json.dumps(header, ensure_ascii=False)
    inputs.sparkSession.range(1, numPartitions=1).select(F.lit(line).alias("value")).write.text(f"{path}/run")
