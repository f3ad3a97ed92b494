"""Page table, text functions and texts put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blattwerk import fixed
from blattwerk.functions import lookups, records, text
from blattwerk.operators import documents, pages as ops
from blattwerk.operators.ordering import number_rows
from blattwerk.session import new_table_path, stage
from blattwerk.sinks import writers
from blattwerk.sources import files, stores
from catalog import inputs
from catalog.registry import base, literal, norm, query, stem, strip

PAGES = inputs.with_tables("pages")
RECORDS = inputs.with_tables("records")
KEY = "method, document, page"
KEYS = ["method", "document", "page"]


# --- Choosing pages ---------------------------------------------------------------

SPEC = (
    "CAST(l_linenumber AS STRING) || ', ' || CAST(l_linenumber + 4 AS STRING) || '-' "
    "|| CAST(l_linenumber + CAST(l_quantity AS INT) % 9 AS STRING) || ',3'"
)


@query(
    "parse_page_range",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, {SPEC} AS spec, array_to_string(list_sort(list_distinct(
      [l_linenumber, 3] || generate_series(l_linenumber + 4, l_linenumber + CAST(trunc(l_quantity) AS INT) % 9)
      )), ',') AS numbers FROM lineitem""",
)
def parse_page_range(spark: SparkSession, folder: str) -> DataFrame:
    lines = inputs.table(spark, folder, "lineitem", heavy=True).select(
        "l_orderkey", "l_partkey", "l_linenumber", F.expr(SPEC).alias("spec")
    )
    return lines.withColumn("numbers", F.array_join(text.page_range(F.col("spec")), ","))


@query(
    "select_pages",
    f"""{PAGES} SELECT {KEY}, content FROM v_pages
    WHERE CASE length(document) % 3 WHEN 0 THEN page <> 2 WHEN 1 THEN true ELSE page = 2 END""",
)
def select_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges that differ by document; a downward one holds nothing, so it keeps every page."""
    spec = F.expr("CASE length(document) % 3 WHEN 0 THEN '1,3-2000000000' WHEN 1 THEN '5-3' ELSE ' 2 ' END")
    chosen = ops.select_pages(inputs.pages(spark, folder), bounds=text.page_bounds(spec))
    return chosen.select(*KEYS, "content")


@query(
    "drop_blank_pages",
    f"{PAGES} SELECT {KEY}, content FROM v_pages WHERE {strip('content')} <> ''",
)
def drop_blank_pages(spark: SparkSession, folder: str) -> DataFrame:
    return ops.drop_blank_pages(inputs.pages(spark, folder)).select(*KEYS, "content")


@query("sort_pages", f"{PAGES} SELECT {KEY}, row_number() OVER (ORDER BY document, page, method) AS place FROM v_pages")
def sort_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with the place at which the sorted table holds them."""
    held = ops.sort_pages(inputs.pages(spark, folder).select(*KEYS)).withColumn("at", F.monotonically_increasing_id())
    return number_rows(held, F.col("at"), "place").drop("at")


def written_lines(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """Lines of text files below ``path`` with their place, files in name order.

    ``by`` names the folders ``<by>=<value>`` whose files are one text each.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    own = [F.regexp_extract("_metadata.file_path", f"{by}=([^/]*)/", 1).alias(by)] if by else []
    found = lines.select(F.col("value").alias("line"), at.alias("at"), *own)
    return number_rows(found, F.col("at"), "place", by).drop("at")


def paths_below(folder: str) -> Column:
    """Column ``path`` without the folder before it."""
    return F.substr("path", F.lit(len(stores.full(folder)) + 2))


# --- Titles, sources, labels --------------------------------------------------------

TITLE_LINE = (
    f"list_filter(list_transform(string_split({strip('content')}, chr(10)), lambda x: {strip('x')}), "
    "lambda x: starts_with(x, '# ') OR starts_with(x, '**Titel'))[1]"
)


@query(
    "markdown_title",
    f"""{PAGES}, lines AS (SELECT {KEY}, {TITLE_LINE} AS line FROM v_pages)
    SELECT {KEY}, CASE WHEN line IS NULL THEN '' WHEN starts_with(line, '# ') THEN {strip('substr(line, 3)')}
      WHEN contains(line, ':') THEN trim({strip("substr(line, strpos(line, ':') + 1)")}, '*') ELSE '' END AS title
    FROM lines""",
)
def markdown_title(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.pages(spark, folder).select(*KEYS, text.markdown_title(F.col("content")).alias("title"))


@query(
    "source_from_notes",
    f"""{PAGES}, lines AS (
      SELECT {KEY}, {strip("list_filter(string_split(content || chr(10) || '  ' || notes || ' ', chr(10)), lambda x: contains(x, 'source_file='))[1]")} AS line
      FROM v_pages)
    SELECT {KEY}, CASE WHEN page % 3 = 0 THEN '' ELSE {strip('substr(line, 13)')} END AS source FROM lines""",
)
def source_from_notes(spark: SparkSession, folder: str) -> DataFrame:
    notes = F.concat(
        "content", F.lit("\n  "),
        F.when(F.expr("page % 3 = 0"), "kein Verweis: x=1").otherwise(F.concat("notes", F.lit(" "))),
    )
    return inputs.pages(spark, folder).select(*KEYS, text.source_from_notes(notes).alias("source"))


LOG = "content || chr(10) || '  ' || chr(10) || ' == ' || chr(10) || ' PATCHES: 2' || chr(10) || 'ende '"
LOG_LINES = f"string_split({strip('log')}, chr(10))"


@query(
    "clean_engine_log",
    f"""{PAGES}, logs AS (SELECT {KEY}, {LOG} AS log FROM v_pages)
    SELECT {KEY}, {strip(f'''array_to_string(list_transform(list_filter({LOG_LINES},
        lambda x: NOT regexp_full_match({strip('x')}, '=+') AND NOT starts_with({strip('x')}, 'BASE:')
        AND NOT starts_with({strip('x')}, 'PATCHES:')),
        lambda x: CASE WHEN {strip('x')} = '' THEN '' ELSE x END), chr(10))''')} AS text FROM logs""",
)
def clean_engine_log(spark: SparkSession, folder: str) -> DataFrame:
    log = F.expr(LOG)
    return inputs.pages(spark, folder).select(*KEYS, text.clean_engine_log(log).alias("text"))


@query(
    "fallback_text",
    f"""{RECORDS}, shown AS (SELECT {KEY},
      {strip("CASE WHEN vector_ready_text <> '' THEN vector_ready_text ELSE content END")} AS t FROM v_records)
    SELECT {KEY}, CASE WHEN t = '' THEN {literal(fixed.NO_TEXT)} ELSE t END AS text FROM shown""",
)
def fallback_text(spark: SparkSession, folder: str) -> DataFrame:
    shown = text.fallback_text(F.col("vector_ready_text"), F.col("content"), fixed.NO_TEXT)
    return inputs.records(spark, folder).select(*KEYS, shown.alias("text"))


LABEL = "CASE WHEN title = '' THEN 'Slide ' || CAST(page AS STRING) ELSE title END"


@query("page_label", f"{RECORDS} SELECT {KEY}, {LABEL} AS label FROM v_records")
def page_label(spark: SparkSession, folder: str) -> DataFrame:
    label = text.page_label(F.col("title"), F.col("page"))
    return inputs.records(spark, folder).select(*KEYS, label.alias("label"))


@query(
    "join_text_parts",
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(
      string_split(text, '.'), lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM conversations""",
)
def join_text_parts(spark: SparkSession, folder: str) -> DataFrame:
    joined = text.join_parts(F.split("text", r"\."))
    return inputs.table(spark, folder, "conversations", heavy=True).select("conv_id", "turn", joined.alias("text"))


# --- Records and numbers ------------------------------------------------------------------

FULL = f"""{PAGES}, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY method, document ORDER BY page) AS INT) AS n,
    row_number() OVER (PARTITION BY method ORDER BY string_split(document, '/'), page) AS g FROM v_pages)"""


@query("number_pages_in_document", f"{FULL} SELECT {KEY}, n AS number FROM numbered")
def number_pages_in_document(spark: SparkSession, folder: str) -> DataFrame:
    return ops.number_pages_in_document(inputs.pages(spark, folder).select(*KEYS))


@query("number_pages_global", f"{FULL} SELECT {KEY}, n AS number, g AS slide_number FROM numbered")
def number_pages_global(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.pages(spark, folder).select(*KEYS)
    return ops.number_pages_global(ops.number_pages_in_document(pages), number="number")


@query(
    "page_record_pdf",
    f"""{FULL} SELECT method, document, n AS page, content, {stem('document')} || '_page_'
      || CASE WHEN n < 1000 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END AS title FROM numbered""",
)
def page_record_pdf(spark: SparkSession, folder: str) -> DataFrame:
    return ops.pdf_records(inputs.pages(spark, folder).select(*KEYS, "content"))


@query(
    "page_record_folder",
    f"""{FULL} SELECT {KEY}, content, g AS slide_number, {base('document')} || ' / Seite ' || CAST(n AS STRING) AS title,
      'source_file=' || document AS notes FROM numbered""",
)
def page_record_folder(spark: SparkSession, folder: str) -> DataFrame:
    return ops.folder_records(inputs.pages(spark, folder).select(*KEYS, "content"))


NOTES = "CASE WHEN page % 5 = 0 THEN 'ohne' WHEN page % 2 = 0 THEN notes || '/x.pdf' ELSE notes END"
SOURCE = f"CASE WHEN page % 5 = 0 THEN '{fixed.UNKNOWN_SOURCE}' ELSE substr({NOTES}, 13) END"
GROUPED = f"""{RECORDS}, numbered AS (
    SELECT *, {SOURCE} AS source,
      row_number() OVER (PARTITION BY method ORDER BY string_split(document, '/'), page) AS slide_number FROM v_records),
  grouped AS (SELECT *, min(slide_number) OVER (PARTITION BY method, source) AS first_page FROM numbered)"""


def _run_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as folder runs leave them, from several sources, each method a run."""
    pages = inputs.records(spark, folder)
    numbered = ops.number_pages_global(pages)
    return stage(numbered.withColumn("notes", F.expr(NOTES)), "run-pages")


@query(
    "group_pages_by_source",
    f"{GROUPED} SELECT method, slide_number, source, {base('source')} AS name, first_page FROM grouped",
)
def group_pages_by_source(spark: SparkSession, folder: str) -> DataFrame:
    grouped = ops.group_pages_by_source(_run_pages(spark, folder), "slide_number")
    return grouped.select("method", "slide_number", "source", "name", "first_page")


@query(
    "batch_time_share",
    f"""{PAGES} SELECT {KEY}, document AS batch,
      sum(length(content)) OVER (PARTITION BY method, document) / CAST(8 AS DOUBLE)
        / count(*) OVER (PARTITION BY document) AS seconds
    FROM v_pages""",
)
def batch_time_share(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a document are one batch; each method's text gives its time."""
    pages = inputs.pages(spark, folder)
    seconds = pages.groupBy("method", "document").agg(
        (F.sum(F.length("content")) / F.lit(8.0)).alias("batch_seconds")
    )
    timed = pages.select(*KEYS, F.col("document").alias("batch")).join(seconds, ["method", "document"])
    return ops.batch_time_share(timed).select(*KEYS, "batch", "seconds")


@query(
    "zip_pages_texts",
    f"""{PAGES}, texts AS (SELECT document, page, content AS text FROM v_pages
      WHERE method = 'glm-ocr/glm-ocr/structured' AND {strip('content')} <> '')
    SELECT {KEY}, text FROM v_pages JOIN texts USING (document, page)
    WHERE method = 'deepseek-ocr2/vllm/structured'""",
)
def zip_pages_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.pages(spark, folder)
    first, second = (pages.where(F.col("method") == method) for method in inputs.METHODS)
    texts = ops.drop_blank_pages(second).select("document", "page", F.col("content").alias("text"))
    return ops.zip_pages_texts(first.select(*KEYS), texts).select(*KEYS, "text")


# --- Whole documents ----------------------------------------------------------------------

@query(
    "document_text",
    f"""{PAGES} SELECT method, document, count(*) AS pages, sum(seconds) AS seconds,
      coalesce(string_agg(content, chr(10) || chr(10) ORDER BY page)
        FILTER (WHERE {strip('content')} <> ''), '') AS text
    FROM v_pages GROUP BY ALL""",
)
def document_text(spark: SparkSession, folder: str) -> DataFrame:
    return ops.document_text(inputs.pages(spark, folder))


TABLE = "'| Dokument | Seite |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || document || ' | ' || CAST(page AS STRING) || ' |'"
BLOCK = f"""concat_ws(chr(10) || chr(10),
  '=== Slide ' || CAST(page AS STRING) || CASE WHEN title = '' THEN '' ELSE ': ' || title END || ' ===',
  nullif(content, ''),
  CASE WHEN page % 4 = 0 THEN chr(10) || '[Tabelle]' || chr(10) || {TABLE} END,
  CASE WHEN {strip('vector_ready_text')} <> '' THEN chr(10) || '[Vector-Ready Text]' || chr(10) || {strip('vector_ready_text')} END,
  chr(10) || '[Speaker Notes]' || chr(10) || notes)"""


@query("page_text", f"{RECORDS} SELECT {KEY}, {BLOCK} AS text FROM v_records")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.records(spark, folder).select(*KEYS, records.page_text(include_notes=True).alias("text"))


@query(
    "page_json",
    f"""{RECORDS} SELECT {KEY}, '{{"slide_number":' || CAST(page AS STRING) || ',"title":' || to_json(title)
      || ',"content":' || to_json(content)
      || CASE WHEN page % 4 = 0 THEN ',"tables":[{{"headers":["Dokument","Seite"],"rows":[["' || document || '","'
        || CAST(page AS STRING) || '"]]}}]' ELSE '' END
      || ',"notes":' || to_json(notes)
      || CASE WHEN vector_ready_text = '' THEN '' ELSE ',"vector_ready_text":' || to_json(vector_ready_text) END
      || ',"_meta":{{"method":"' || method || '","time_seconds":' || CAST(round(seconds, 3) AS STRING)
      || ',"token_count":' || CAST(tokens AS STRING) || '}}}}' AS record FROM v_records""",
)
def page_json(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.records(spark, folder).select(*KEYS, records.page_json().alias("record"))


MD_BLOCK = f"""chr(10) || '## Page ' || CAST(page AS STRING) || chr(10) || chr(10)
  || CASE WHEN {strip('content')} = '' THEN {literal(fixed.NO_PAGE_TEXT)} ELSE {strip('content')} END"""


@query(
    "write_pages_markdown",
    f"""{PAGES} SELECT replace(method, '/', '_') || '/' || document || '.md' AS file,
      '# ' || document || ' (OCR)' || chr(10) || string_agg({MD_BLOCK}, chr(10) ORDER BY page) || chr(10) AS markdown
    FROM v_pages GROUP BY method, document""",
)
def write_pages_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The written files, read back."""
    path = new_table_path(spark, "markdown")
    writers.write_pages_markdown(inputs.pages(spark, folder), path, "OCR")
    found = files.read_files(spark, path, [".md"], recursive=True)
    return found.select(paths_below(path).alias("file"), F.decode("content", "UTF-8").alias("markdown"))


@query(
    "write_pages_text",
    f"""{RECORDS}, blocks AS (SELECT {BLOCK} AS block,
        row_number() OVER (ORDER BY document, page, method) AS place FROM v_records),
      split AS (SELECT place, string_split(CASE WHEN place = 1 THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) END
        || block, chr(10)) AS lines FROM blocks)
    SELECT line, row_number() OVER (ORDER BY place, i) AS place FROM (
      SELECT place, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split) t""",
)
def write_pages_text(spark: SparkSession, folder: str) -> DataFrame:
    """The written text, line by line."""
    path = new_table_path(spark, "pages-text")
    writers.write_pages_text(inputs.records(spark, folder), path, include_notes=True)
    return written_lines(spark, path)


VECTOR_TEXT = strip("CASE WHEN vector_ready_text <> '' THEN vector_ready_text ELSE content END")
VECTOR_BLOCKS = f"""{GROUPED}, blocks AS (
    SELECT method, first_page, source, slide_number AS page, chr(10) || '### ' ||
      CASE WHEN title = '' THEN 'Slide ' || CAST(slide_number AS STRING) ELSE title END || chr(10) || chr(10) ||
      CASE WHEN {VECTOR_TEXT} = '' THEN {literal(fixed.NO_TEXT)} ELSE {VECTOR_TEXT} END AS block FROM grouped
    UNION ALL
    SELECT DISTINCT method, first_page, source, NULL, chr(10) || '## Dokument: ' || {base('source')} FROM grouped)"""


@query("vector_ready_blocks", f"{VECTOR_BLOCKS} SELECT method, first_page, source, page, block FROM blocks")
def vector_ready_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return documents.vector_ready_blocks(_run_pages(spark, folder), "slide_number")


@query(
    "write_vector_ready",
    f"""{VECTOR_BLOCKS}, split AS (
      SELECT method, row_number() OVER (PARTITION BY method ORDER BY first_page, source, page NULLS FIRST) AS n,
        string_split(block, chr(10)) AS lines FROM blocks
      UNION ALL SELECT DISTINCT method, 0, ['{fixed.VECTOR_READY_HEADING}'] FROM blocks)
    SELECT replace(method, '/', '_') AS method, line, row_number() OVER (PARTITION BY method ORDER BY n, i) AS place FROM (
      SELECT method, n, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split) t""",
)
def write_vector_ready(spark: SparkSession, folder: str) -> DataFrame:
    """The written Markdown of each method, line by line."""
    path = new_table_path(spark, "vector-ready")
    writers.write_vector_ready(_run_pages(spark, folder), path, "slide_number")
    return written_lines(spark, path, by="method")


# --- Scalar functions ----------------------------------------------------------------------

@query(
    "strip_text",
    f"{PAGES} SELECT {KEY}, {strip('chr(28) || content || chr(8195)')} AS text FROM v_pages",
)
def strip_text(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\x1c"), F.col("content"), F.lit("\u2003"))
    return inputs.pages(spark, folder).select(*KEYS, text.strip(padded).alias("text"))


@query(
    "norm_space",
    f"SELECT doc_id, {norm('chr(160) || text || chr(11)')} AS text FROM documents",
)
def norm_space(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\xa0"), F.col("text"), F.lit("\x0b"))
    return inputs.table(spark, folder, "documents", heavy=True).select("doc_id", text.norm_space(padded).alias("text"))


@query("estimate_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "documents").select(
        "doc_id", text.estimate_tokens(F.col("text")).alias("tokens")
    )


@query(
    "normalize_value",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: {norm('x')}),
      lambda x: x <> ''), ' | ') AS listed, {norm('text')} AS single FROM documents""",
)
def normalize_value(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "documents", heavy=True).select(
        "doc_id",
        text.normalize_value(F.split("text", r"\."), is_list=True).alias("listed"),
        text.normalize_value(F.col("text")).alias("single"),
    )


ROWS = "list_transform(string_split(text, chr(10)), lambda r: string_split(r, ','))"


def _text_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a document as table rows, split at commas; every second one has a header."""
    rows = F.transform(F.split("text", "\n"), lambda row: F.split(row, ","))
    nothing = F.array().cast("array<string>")
    with_header = F.expr("doc_id % 2 = 0")
    return inputs.table(spark, folder, "documents", heavy=True).select(
        "doc_id",
        F.struct(
            F.when(with_header, F.get(rows, F.lit(0))).otherwise(nothing).alias("headers"),
            F.when(with_header, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows).alias("rows"),
        ).alias("t"),
    )


@query(
    "table_markdown",
    f"""WITH t AS (SELECT doc_id, {ROWS} AS r FROM documents),
      w AS (SELECT *, len(r[1]) AS n FROM t),
      b AS (SELECT *, list_transform(CASE WHEN doc_id % 2 = 0 THEN r[2:] ELSE r END, lambda x: '| ' ||
        array_to_string(list_transform(generate_series(1, n), lambda i: coalesce(x[i], '')), ' | ') || ' |') AS body FROM w)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_concat(
        ['| ' || array_to_string(r[1], ' | ') || ' |',
         '| ' || array_to_string(list_transform(generate_series(1, n), lambda i: '---'), ' | ') || ' |'], body), chr(10))
      ELSE array_to_string(body, chr(10)) END AS markdown FROM b""",
)
def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _text_tables(spark, folder).select("doc_id", records.table_markdown(F.col("t")).alias("markdown"))


@query(
    "table_json",
    f"""WITH t AS (SELECT doc_id, {ROWS} AS r FROM documents)
    SELECT doc_id, '{{"headers":' || CASE WHEN doc_id % 2 = 0 THEN to_json(r[1]) ELSE '[]' END || ',"rows":'
      || to_json(CASE WHEN doc_id % 2 = 0 THEN r[2:] ELSE r END) || '}}' AS record FROM t""",
)
def table_json(spark: SparkSession, folder: str) -> DataFrame:
    return _text_tables(spark, folder).select("doc_id", records.table_json(F.col("t")).alias("record"))


# --- Look-ups -------------------------------------------------------------------------------

ORDERS = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 2 = 0 THEN 'deepseek' ELSE 'glm' END AS engine,
  CASE o_orderkey % 3 WHEN 0 THEN 'deck' WHEN 1 THEN 'pdf' ELSE 'image' END AS input_kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'structured' WHEN 2 THEN 'slide'
    WHEN 3 THEN 'invoice' ELSE 'free' END AS mode,
  CASE WHEN o_orderkey % 4 = 0 THEN 'anthropic' ELSE 'openai' END AS provider,
  CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' END AS model
FROM {rows}"""
SETTINGS = f"WITH s AS ({ORDERS.format(rows='orders')}) "


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    """Run settings, one per order."""
    return spark.sql(ORDERS, rows=inputs.table(spark, folder, "orders"))


MODEL = (
    "CASE WHEN model IS NOT NULL AND model <> '' THEN model "
    "WHEN provider = 'anthropic' THEN 'claude-opus-4-5-20251101' ELSE 'gpt-5.2' END"
)


@query(
    "method_label",
    f"""{SETTINGS} SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'vision-' || provider || '/' || {MODEL}
      WHEN 1 THEN 'deepseek-ocr2/vllm/' || mode
      WHEN 2 THEN 'glm-ocr/' || coalesce(nullif(model, ''), 'glm-ocr') || '/' || mode
      WHEN 3 THEN 'easyocr-local' ELSE 'direct' END AS label FROM s""",
)
def method_label(spark: SparkSession, folder: str) -> DataFrame:
    engine = F.expr("element_at(array('vision', 'deepseek', 'glm', 'easyocr', 'direct'), CAST(o_orderkey % 5 AS INT) + 1)")
    model = F.when(engine == "deepseek", F.lit("vllm")).otherwise(F.col("model"))
    label = lookups.method_label(engine, F.col("provider"), model, F.col("mode"))
    return _settings(spark, folder).select("o_orderkey", label.alias("label"))


@query(
    "resolve_prompt_mode",
    f"""{SETTINGS} SELECT o_orderkey, CASE
      WHEN input_kind IN ('deck', 'pdf') AND mode = 'markdown' THEN 'markdown'
      WHEN input_kind IN ('deck', 'pdf') THEN 'structured'
      WHEN engine = 'deepseek' AND mode IN ('slide', 'invoice') THEN 'structured'
      WHEN engine = 'deepseek' THEN mode
      WHEN mode = 'invoice' THEN 'invoice' ELSE 'structured' END AS engine_mode FROM s""",
)
def resolve_prompt_mode(spark: SparkSession, folder: str) -> DataFrame:
    mode = lookups.engine_mode(F.col("engine"), F.col("input_kind"), F.col("mode"))
    return _settings(spark, folder).select("o_orderkey", mode.alias("engine_mode"))


@query("resolve_model", f"{SETTINGS} SELECT o_orderkey, {MODEL} AS model FROM s")
def resolve_model(spark: SparkSession, folder: str) -> DataFrame:
    model = lookups.resolve_model(F.col("provider"), F.col("model"))
    return _settings(spark, folder).select("o_orderkey", model.alias("model"))


def _prompt_case() -> str:
    from catalog.registry import case

    deepseek, glm = fixed.DEEPSEEK_PROMPTS, fixed.GLM_PROMPTS
    return (
        f"CASE WHEN engine = 'deepseek' THEN {case('mode', deepseek, deepseek['structured'])} "
        f"ELSE {case('mode', glm, glm['structured'])} END"
    )


@query("prompt_lookup", f"{SETTINGS} SELECT o_orderkey, {_prompt_case()} AS prompt FROM s")
def prompt_lookup(spark: SparkSession, folder: str) -> DataFrame:
    prompt = lookups.engine_prompt(F.col("engine"), F.col("mode"))
    return _settings(spark, folder).select("o_orderkey", prompt.alias("prompt"))


VISION = f"CASE WHEN mode = 'invoice' THEN {literal(fixed.VISION_INVOICE_PROMPT)} ELSE {literal(fixed.VISION_SLIDE_PROMPT)} END"


@query("vision_prompt_lookup", f"{SETTINGS} SELECT o_orderkey, {VISION} AS prompt FROM s")
def vision_prompt_lookup(spark: SparkSession, folder: str) -> DataFrame:
    prompt = lookups.vision_prompt(F.col("mode"))
    return _settings(spark, folder).select("o_orderkey", prompt.alias("prompt"))
