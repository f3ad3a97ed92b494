"""Comparison of extraction methods: summaries and report lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from blattwerk import fixed
from blattwerk.functions import lookups
from blattwerk.functions.text import fixed_decimals, stored_or_estimated_tokens
from blattwerk.operators.pages import preview_pages, union_all
from blattwerk.session import stage


def reject_methods(requests: DataFrame, asked: str = "asked") -> DataFrame:
    """Adds ``invalid``: the asked names that are not allowed, joined by a comma."""
    names = F.transform(F.split(asked, ","), lambda name: F.trim(name))
    return requests.withColumn("invalid", F.array_join(lookups.invalid_methods(names), ", "))


def benchmark_notes(engine: Column, input_kind: str, mode: str, quantize_4bit: bool) -> Column:
    precision = fixed.FOUR_BIT if quantize_4bit else fixed.FULL_PRECISION
    result = F.lit("")
    for name, template in fixed.BENCHMARK_NOTES[input_kind].items():
        note = F.replace(
            F.lit(template.replace("{precision}", precision)),
            F.lit("{mode}"),
            lookups.engine_mode(F.lit(name), F.lit(input_kind), F.lit(mode)),
        )
        result = F.when(engine.startswith(name), note).otherwise(result)
    return result


def method_totals(
    pages: DataFrame,
    input_kind: str = "deck",
    mode: str = "structured",
    quantize_4bit: bool = False,
    costs: Mapping[str, float] = fixed.COST_PER_PAGE,
) -> DataFrame:
    """Totals per method, not rounded."""
    totals = pages.groupBy("method").agg(
        F.count("*").alias("total_slides"),
        F.sum("seconds").alias("total_time_seconds"),
        F.sum(F.length("content")).alias("total_chars"),
        F.sum(stored_or_estimated_tokens(F.col("tokens"), F.col("content"))).alias(
            "total_tokens_estimate"
        ),
    )
    return _finish_totals(totals, input_kind, mode, quantize_4bit, costs)


def _finish_totals(
    totals: DataFrame, input_kind: str, mode: str, quantize_4bit: bool, costs: Mapping[str, float]
) -> DataFrame:
    slides = F.col("total_slides")
    return (
        totals.withColumn(
            "avg_time_per_slide",
            F.coalesce(F.col("total_time_seconds") / F.nullif(slides, F.lit(0)), F.lit(0.0)),
        )
        .withColumn("estimated_cost_usd", lookups.cost_per_page(F.col("method"), costs) * slides)
        .withColumn("gpu_required", F.lit(True))
        .withColumn("notes", benchmark_notes(F.col("method"), input_kind, mode, quantize_4bit))
    )


def empty_method_totals(totals: DataFrame, methods: list[str], **settings: object) -> DataFrame:
    """Zero rows for the asked methods without any page, under their plain label."""
    labels = [
        label for name in methods for label in fixed.COST_PER_PAGE if label.startswith(name)
    ]
    asked = (
        totals.sparkSession.range(1, numPartitions=1)
        .select(F.explode(F.array(*[F.lit(label) for label in dict.fromkeys(labels)])).alias("method"))
        .withColumn("total_slides", F.lit(0).cast("bigint"))
        .withColumn("total_time_seconds", F.lit(0.0))
        .withColumn("total_chars", F.lit(0).cast("bigint"))
        .withColumn("total_tokens_estimate", F.lit(0).cast("bigint"))
    )
    found = totals.select(F.split_part("method", F.lit("/"), F.lit(1)).alias("method")).distinct()
    options = {
        "input_kind": "deck", "mode": "structured", "quantize_4bit": False,
        "costs": fixed.COST_PER_PAGE, **settings,
    }
    return totals.unionByName(_finish_totals(asked.join(found, "method", "left_anti"), **options))


def round_metrics(totals: DataFrame) -> DataFrame:
    """Totals with the decimals in which they are reported."""
    return (
        totals.withColumn("total_time_seconds", F.round("total_time_seconds", 2))
        .withColumn("avg_time_per_slide", F.round("avg_time_per_slide", 3))
        .withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 4))
    )


def method_summary(pages: DataFrame, **settings: object) -> DataFrame:
    """Slides, time, characters, tokens and cost per method."""
    return round_metrics(method_totals(pages, **settings))


def handwriting_items(pages: DataFrame) -> DataFrame:
    """Per image: text, rewritten text, characters and tokens."""
    return pages.select(
        "method",
        "document",
        "page",
        F.col("content").alias("text"),
        "vector_ready_text",
        F.length("content").alias("chars"),
        F.col("tokens").alias("tokens_estimate"),
    )


def handwriting_summary(pages: DataFrame) -> DataFrame:
    """Items and seconds of both passes per method."""
    ocr, post = F.sum("seconds"), F.sum("post_seconds")
    return pages.groupBy("method").agg(
        F.count("*").alias("total_items"),
        F.round(ocr, 3).alias("ocr_time_seconds"),
        F.round(post, 3).alias("post_processing_time_seconds"),
        F.round(ocr + post, 3).alias("total_time_seconds"),
        F.round((ocr + post) / F.count("*"), 3).alias("avg_time_seconds"),
    )


def _fixed_lines(like: DataFrame, section: int, lines: list[str]) -> DataFrame:
    texts = F.posexplode(F.array(*[F.lit(line) for line in lines])).alias("line_no", "line")
    return like.sparkSession.range(1, numPartitions=1).select(
        F.lit(section).alias("section"), F.lit(0).alias("method_order"), F.lit("").alias("method"), texts
    )


def _method_lines(
    rows: DataFrame, section: int, lines: list[tuple[Column | int, Column]], order: list[str] | None = None
) -> DataFrame:
    pairs = [
        F.struct(
            (number if isinstance(number, Column) else F.lit(number)).cast("int").alias("line_no"),
            line.alias("line"),
        )
        for number, line in lines
    ]
    return rows.select(
        F.lit(section).alias("section"),
        lookups.method_order(F.col("method"), order).alias("method_order"),
        "method",
        F.inline(F.array(*pairs)),
    )


REPORT_ORDER = ["section", "method_order", "method", "line_no"]


def benchmark_report(totals: DataFrame, pages: DataFrame) -> DataFrame:
    """Markdown report as lines; ``REPORT_ORDER`` puts them in order.

    A handful of lines per method, however many pages there are. The totals, one
    row per method, are written once; pages are read for them and for the preview.
    """
    totals = stage(totals, "method-totals")

    def join(*parts: object) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    c = F.col
    cost = F.when(
        c("estimated_cost_usd") > 0, join("$", fixed_decimals(c("estimated_cost_usd"), 4))
    ).otherwise("lokal")
    seconds = fixed_decimals(c("total_time_seconds"), 2)
    mean = fixed_decimals(c("avg_time_per_slide"), 3)
    row = join(
        "| ", c("method"), " | ", c("total_slides"), " | ", seconds, " | ", mean, " | ",
        c("total_chars"), " | ", c("total_tokens_estimate"), " | ", cost, " | ",
        F.when(c("gpu_required"), "✓").otherwise("✗"), " |",
    )
    details = [
        (0, join("### ", c("method"), "\n")),
        (1, join("- **Notizen**: ", c("notes"))),
        (2, join("- **Gesamtzeit**: ", seconds, "s")),
        (3, join("- **Durchsatz**: ", mean, "s/Slide\n")),
    ]
    preview = [
        (c("place") * 2 + 2, join("**Slide ", c("page"), "** (", c("chars"), " Zeichen):")),
        (c("place") * 2 + 3, join("> ", c("preview"), "...\n")),
    ]
    shown = 3
    more = c("total_slides") - F.lit(shown)
    rest = [(100, join("*... und ", more, " weitere Slides*\n"))]
    return union_all(
        [
            _fixed_lines(totals, 0, fixed.BENCHMARK_HEAD),
            _method_lines(totals, 1, [(0, row)]),
            _fixed_lines(totals, 2, [fixed.BENCHMARK_DETAILS]),
            _method_lines(totals, 3, details),
            _method_lines(preview_pages(pages, count=shown), 3, preview),
            _method_lines(totals.where(more > 0), 3, rest),
        ]
    )


def local_benchmark_report(
    handwriting: DataFrame,
    invoices: DataFrame,
    counts: DataFrame,
    handwriting_dir: str,
    invoices_dir: str,
    provider: str = "openai",
    model: str | None = None,
    methods: list[str] | None = None,
) -> DataFrame:
    """Markdown report of the handwriting and invoice summaries, as lines.

    ``counts`` has one row with ``images`` and ``pdfs``; ``methods`` is the order of methods.
    """
    c = F.col

    def table_row(*cells: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    title = [fixed.LOCAL_TITLE, "", "## Inputs"] + [
        line.format(handwriting_dir=handwriting_dir, invoices_dir=invoices_dir)
        for line in fixed.LOCAL_INPUTS
    ]
    count_lines = counts.select(
        F.lit(1).alias("section"),
        F.lit(0).alias("method_order"),
        F.lit("").alias("method"),
        F.posexplode(
            F.array(
                F.concat(F.lit("- Handschrift-Dateien: "), c("images").cast("string")),
                F.concat(F.lit("- Rechnungs-PDFs: "), c("pdfs").cast("string")),
            )
        ).alias("line_no", "line"),
    )
    seconds = [fixed_decimals(c(name), 3) for name in ("total_time_seconds", "avg_time_seconds")]
    items = c("total_items").cast("string")
    fill = F.concat(fixed_decimals(c("avg_property_fill_ratio") * 100, 2), F.lit("%"))
    llm = f"- Property/Post-Processing LLM: {provider} / {model or '(default)'}"
    return union_all(
        [
            _fixed_lines(counts, 0, title),
            count_lines,
            _fixed_lines(counts, 2, [llm, "", *fixed.LOCAL_HANDWRITING_HEAD]),
            _method_lines(handwriting, 3, [(0, table_row(c("method"), items, *seconds))], methods),
            _fixed_lines(counts, 4, ["", *fixed.LOCAL_INVOICE_HEAD]),
            _method_lines(invoices, 5, [(0, table_row(c("method"), items, *seconds, fill))], methods),
            _fixed_lines(counts, 6, ["", *fixed.LOCAL_NOTES, ""]),
        ]
    )
