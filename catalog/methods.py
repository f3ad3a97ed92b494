"""Method comparison and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blattwerk import fixed
from blattwerk.functions import lookups
from blattwerk.operators import comparing, invoices as invoice_ops, pages as ops, scoring
from blattwerk.session import new_table_path, stage
from blattwerk.sinks import writers
from blattwerk.sources import files
from catalog import inputs, invoices
from catalog.registry import SUFFIX, literal, query

PAGES = inputs.with_tables("pages")
RECORDS = inputs.with_tables("records")
COSTS = {"deepseek-ocr2": 0.012, "ocr": 0.003}


@query("pages_by_method", """SELECT conv_id, turn, m.method AS method, text
    FROM conversations CROSS JOIN (SELECT unnest(['deepseek', 'glm']) AS method) m""")
def pages_by_method(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return ops.pages_by_method(rows, ["glm", "deepseek", "glm"])


@query(
    "cost_lookup",
    f"""{PAGES}, costs AS (SELECT * FROM (VALUES (1, 'deepseek-ocr2', 0.012), (2, 'ocr', 0.003)) c(ord, name, cost))
    SELECT method, document, page, coalesce((SELECT arg_min(CAST(cost AS DOUBLE), ord) FROM costs
      WHERE contains(label, name)), 0) AS cost
    FROM (SELECT *, CASE WHEN page % 4 = 0 THEN 'direct' ELSE method END AS label FROM v_pages) t""",
)
def cost_lookup(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.expr("page % 4 = 0"), "direct").otherwise(F.col("method"))
    return inputs.pages(spark, folder).select(
        "method", "document", "page", lookups.cost_per_page(label, COSTS).alias("cost")
    )


@query(
    "reject_methods",
    """SELECT event_id, asked, array_to_string(list_sort(list_distinct(list_filter(
        list_transform(string_split(asked, ','), lambda x: trim(x)), lambda x: x NOT IN ('deepseek', 'glm')))), ', ') AS invalid
    FROM (SELECT event_id, event_type || ', glm,vision,' || CASE WHEN event_id % 2 = 0 THEN 'deepseek' ELSE event_type END
      AS asked FROM events) t""",
)
def reject_methods(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.concat(
        "event_type", F.lit(", glm,vision,"),
        F.when(F.expr("event_id % 2 = 0"), "deepseek").otherwise(F.col("event_type")),
    )
    events = inputs.table(spark, folder, "events").select("event_id", asked.alias("asked"))
    return comparing.reject_methods(events)


@query(
    "union_method_results",
    f"""{PAGES} SELECT method, document, page, content,
      CASE WHEN starts_with(method, 'deepseek') THEN 1 ELSE 2 END AS method_order FROM v_pages""",
)
def union_method_results(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.pages(spark, folder).select("method", "document", "page", "content")
    first, second = (pages.where(F.col("method") == method) for method in inputs.METHODS)
    return ops.union_method_results([second, first])


TOTALS = f"""{RECORDS}, totals AS (
    SELECT method, count(*) AS total_slides, sum(seconds) AS seconds, sum(length(content)) AS total_chars,
      sum(CASE WHEN tokens <> 0 THEN tokens ELSE greatest(1, length(content) // 4) END) AS total_tokens_estimate,
      CASE WHEN contains(method, 'deepseek-ocr2') THEN 0.012 ELSE 0.003 END * CAST(count(*) AS DOUBLE) AS cost
    FROM v_records GROUP BY method)"""
NOTES = (
    "CASE WHEN starts_with(method, 'deepseek') THEN 'Lokal, 4-bit, DSGVO-konform, Modus: markdown' "
    "ELSE 'Lokal gehostetes Vision-OCR (OpenAI-kompatibler Endpoint), Modus: markdown' END"
)
SETTINGS = {"input_kind": "deck", "mode": "markdown", "quantize_4bit": True, "costs": COSTS}
SUMMARY = f"""SELECT method, total_slides, round(seconds, 2) AS total_time_seconds,
  round(seconds / total_slides, 3) AS avg_time_per_slide, CAST(total_chars AS BIGINT) AS total_chars,
  CAST(total_tokens_estimate AS BIGINT) AS total_tokens_estimate, round(cost, 4) AS estimated_cost_usd,
  true AS gpu_required, {NOTES} AS notes FROM totals"""


@query("method_summary", f"{TOTALS} {SUMMARY}")
def method_summary(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.method_summary(inputs.records(spark, folder), **SETTINGS)


@query(
    "round_metrics",
    f"""{PAGES} SELECT method, document, page, round(seconds / 7, 2) AS total_time_seconds,
      round(seconds / 7, 3) AS avg_time_per_slide, round(seconds / 7, 4) AS estimated_cost_usd FROM v_pages""",
)
def round_metrics(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("seconds") / 7
    pages = inputs.pages(spark, folder).select(
        "method", "document", "page", value.alias("total_time_seconds"), value.alias("avg_time_per_slide"),
        value.alias("estimated_cost_usd"),
    )
    return comparing.round_metrics(pages)


PREVIEW = f"""placed AS (SELECT *, CAST(length(content) AS INT) AS chars, replace(substr(content, 1, 200), chr(10), ' ') AS preview,
    CAST(row_number() OVER (PARTITION BY method ORDER BY string_split(document, '/'), page) AS INT) AS place,
    greatest(count(*) OVER (PARTITION BY method) - 3, 0) AS more FROM v_records)"""


@query(
    "preview_pages",
    f"{RECORDS}, {PREVIEW} SELECT method, place, document, page, chars, preview, more FROM placed WHERE place <= 3",
)
def preview_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.records(spark, folder)
    return ops.preview_pages(pages).join(ops.more_pages(pages), "method")


def _lines_sql(section: int, lines: list[str]) -> str:
    rows = ", ".join(f"({section}, 0, '', {n}, {literal(line)})" for n, line in enumerate(lines))
    return f"SELECT * FROM (VALUES {rows}) v(section, method_order, method, line_no, line)"


def decimals(number: str, places: int) -> str:
    return f"printf('%.{places}f', round(CAST({number} AS DOUBLE), {places}))"


ORDER = "CASE WHEN starts_with(method, 'deepseek') THEN 1 ELSE 2 END"
MEAN = "seconds / total_slides"
REPORT = f"""{TOTALS}, {PREVIEW}
  {_lines_sql(0, fixed.BENCHMARK_HEAD)}
  UNION ALL SELECT 1, {ORDER}, method, 0, '| ' || method || ' | ' || total_slides || ' | ' || {decimals('seconds', 2)}
    || ' | ' || {decimals(MEAN, 3)} || ' | ' || total_chars || ' | ' || total_tokens_estimate || ' | $'
    || {decimals('cost', 4)} || ' | ✓ |' FROM totals
  UNION ALL {_lines_sql(2, [fixed.BENCHMARK_DETAILS])}
  UNION ALL SELECT 3, {ORDER}, method, 0, '### ' || method || chr(10) FROM totals
  UNION ALL SELECT 3, {ORDER}, method, 1, '- **Notizen**: ' || {NOTES} FROM totals
  UNION ALL SELECT 3, {ORDER}, method, 2, '- **Gesamtzeit**: ' || {decimals('seconds', 2)} || 's' FROM totals
  UNION ALL SELECT 3, {ORDER}, method, 3, '- **Durchsatz**: ' || {decimals(MEAN, 3)} || 's/Slide' || chr(10) FROM totals
  UNION ALL SELECT 3, {ORDER}, method, CAST(2 * place + 2 AS INT), '**Slide ' || page || '** (' || chars || ' Zeichen):'
    FROM placed WHERE place <= 3
  UNION ALL SELECT 3, {ORDER}, method, CAST(2 * place + 3 AS INT), '> ' || preview || '...' || chr(10) FROM placed WHERE place <= 3
  UNION ALL SELECT DISTINCT 3, {ORDER}, method, 100, '*... und ' || more || ' weitere Slides*' || chr(10)
    FROM placed WHERE more > 0"""


@query("benchmark_report", REPORT)
def benchmark_report(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.records(spark, folder)
    return comparing.benchmark_report(comparing.method_totals(pages, **SETTINGS), pages)


@query(
    "write_benchmark_data",
    f"""{TOTALS}, summary AS ({SUMMARY}) SELECT v_records.method, document, page AS slide_number, content, total_slides,
      total_chars, estimated_cost_usd, true AS is_input FROM v_records JOIN summary USING (method)""",
)
def write_benchmark_data(spark: SparkSession, folder: str) -> DataFrame:
    """Results, inputs and pages of a comparison, written and read back."""
    path = new_table_path(spark, "benchmark")
    pages = inputs.records(spark, folder)
    summary = comparing.method_summary(pages, **SETTINGS)
    writers.write_benchmark_data(summary, pages, path)
    results = spark.read.schema(summary.schema).json(f"{path}/results")
    slides = spark.read.schema(
        "document string, slide_number int, content string, by_method string"
    ).json(f"{path}/slides")
    totals = results.select("method", "total_slides", "total_chars", "estimated_cost_usd")
    given = spark.read.schema("path string").json(f"{path}/file").select(
        F.col("path").alias("document"), F.lit(True).alias("is_input")
    )
    return slides.withColumnRenamed("by_method", "method").join(totals, "method").join(given, "document", "left")


# --- Two-task comparison ------------------------------------------------------------------------

HANDWRITING = f"""{RECORDS}, hw AS (SELECT method, count(*) AS total_items, sum(seconds) AS ocr,
    sum(length(content) / CAST(8 AS DOUBLE)) AS post FROM v_records GROUP BY method)"""


def _handwriting(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.records(spark, folder).withColumn("post_seconds", F.length("content") / F.lit(8.0))


@query(
    "handwriting_items",
    f"""{RECORDS} SELECT method, document, page, content AS text, vector_ready_text, CAST(length(content) AS INT) AS chars,
      tokens AS tokens_estimate FROM v_records""",
)
def handwriting_items(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.handwriting_items(inputs.records(spark, folder))


@query(
    "handwriting_summary",
    f"""{HANDWRITING} SELECT method, total_items, round(ocr, 3) AS ocr_time_seconds,
      round(post, 3) AS post_processing_time_seconds, round(ocr + post, 3) AS total_time_seconds,
      round((ocr + post) / total_items, 3) AS avg_time_seconds FROM hw""",
)
def handwriting_summary(spark: SparkSession, folder: str) -> DataFrame:
    return comparing.handwriting_summary(_handwriting(spark, folder))


def _invoice_items(spark: SparkSession, folder: str) -> DataFrame:
    return invoices.items(spark, folder)


def _in(suffixes: list[str]) -> str:
    return f"{SUFFIX} IN ({', '.join(map(literal, suffixes))})"


INVOICE_ORDER = "CASE WHEN method = 'deepseek' THEN 1 ELSE 2 END"
LOCAL_REPORT = f"""{invoices.ITEMS}, {HANDWRITING[5:]}, {inputs.with_tables('manifest')[5:]},
    counts AS (SELECT count(*) FILTER (WHERE {_in(fixed.HANDWRITING_SUFFIXES)}) AS images,
      count(*) FILTER (WHERE {_in(fixed.PDF_SUFFIXES)}) AS pdfs FROM v_manifest),
    inv AS ({invoices.METHOD_SUMMARY})
  {_lines_sql(0, [fixed.LOCAL_TITLE, '', '## Inputs', '- Handschrift-Ordner: `hand`', '- Rechnungs-Ordner: `rechnungen`'])}
  UNION ALL SELECT 1, 0, '', 0, '- Handschrift-Dateien: ' || images FROM counts
  UNION ALL SELECT 1, 0, '', 1, '- Rechnungs-PDFs: ' || pdfs FROM counts
  UNION ALL {_lines_sql(2, ['- Property/Post-Processing LLM: openai / (default)', '', *fixed.LOCAL_HANDWRITING_HEAD])}
  UNION ALL SELECT 3, {ORDER}, method, 0, '| ' || method || ' | ' || total_items || ' | ' || {decimals('ocr + post', 3)}
    || ' | ' || {decimals('(ocr + post) / total_items', 3)} || ' |' FROM hw
  UNION ALL {_lines_sql(4, ['', *fixed.LOCAL_INVOICE_HEAD])}
  UNION ALL SELECT 5, {INVOICE_ORDER}, method, 0, '| ' || method || ' | ' || total_items || ' | '
    || {decimals('total_time_seconds', 3)} || ' | ' || {decimals('avg_time_seconds', 3)} || ' | '
    || {decimals('avg_property_fill_ratio * 100', 2)} || '% |' FROM inv
  UNION ALL {_lines_sql(6, ['', *fixed.LOCAL_NOTES, ''])}"""


@query("local_benchmark_report", LOCAL_REPORT)
def local_benchmark_report(spark: SparkSession, folder: str) -> DataFrame:
    counts = files.file_counts(inputs.manifest(spark, folder)).agg(
        F.sum("images").alias("images"), F.sum("pdfs").alias("pdfs")
    )
    return comparing.local_benchmark_report(
        comparing.handwriting_summary(_handwriting(spark, folder)),
        invoice_ops.invoice_method_summary(_invoice_items(spark, folder)),
        counts,
        "hand",
        "rechnungen",
    )


@query(
    "write_local_benchmark",
    f"""{invoices.SCORED}, {HANDWRITING[5:]}, inv AS ({invoices.METHOD_SUMMARY}),
      keys AS (SELECT document, method, string_agg(key || ':' || pred || ':' || truth || ':' || CAST(exact_match AS VARCHAR),
        ';' ORDER BY key) AS per_key FROM scores GROUP BY document, method)
    SELECT 'handwriting' AS task, v_records.method, document, page, total_items, NULL AS per_key,
      'glm,deepseek' AS methods, true AS is_input FROM v_records JOIN hw USING (method)
    UNION ALL SELECT 'invoices', items.method, document, NULL, total_items, per_key, 'glm,deepseek', true
      FROM items JOIN inv USING (method) LEFT JOIN keys USING (document, method)""",
)
def write_local_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Items, summaries, inputs and header of both tasks, written and read back."""
    path = new_table_path(spark, "local-benchmark")
    handwriting = _handwriting(spark, folder)
    invoice = stage(
        scoring.match_rate(invoices.known(spark, folder, "filled_properties", "filled_ratio", "seconds")), "scored"
    )
    files_of = [
        rows.select(F.lit(task).alias("task"), F.col("document").alias("path")).distinct()
        for task, rows in (("handwriting", handwriting), ("invoices", invoice))
    ]
    writers.write_local_benchmark(
        (comparing.handwriting_items(handwriting), comparing.handwriting_summary(handwriting)),
        (
            invoice.select("method", "document", "filled_properties", "filled_ratio", "seconds", "per_key"),
            invoice_ops.invoice_method_summary(invoice),
        ),
        path,
        {"methods": ["glm", "deepseek"], "llm": {"provider": "openai", "model": "(default)"}},
        files_of[0].unionByName(files_of[1]),
    )
    pair = "struct<key:string,pred:string,truth:string,exact_match:boolean>"
    items = spark.read.schema(
        f"document string, page int, per_key array<{pair}>, task string, method string"
    ).parquet(f"{path}/items")
    methods = spark.read.schema("methods array<string>").json(f"{path}/run").head().methods
    given = spark.read.parquet(f"{path}/inputs").select("task", F.col("path").alias("document"), F.lit(True).alias("is_input"))
    keys = F.array_join(
        F.transform(
            F.array_sort("per_key"), lambda k: F.concat_ws(":", k["key"], k["pred"], k["truth"], k["exact_match"].cast("string"))
        ),
        ";",
    )
    summary = spark.read.schema("method string, total_items bigint, task string").json(f"{path}/summary")
    return (
        items.select("task", "method", "document", "page", keys.alias("per_key"), F.lit(",".join(methods)).alias("methods"))
        .join(summary.select("task", "method", "total_items"), ["task", "method"])
        .join(given, ["task", "document"], "left")
    )
