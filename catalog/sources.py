"""Listings, decks, records and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blattwerk import fixed
from blattwerk.functions import paths, records
from blattwerk.operators.ordering import number_rows
from blattwerk.operators.pages import image_records, number_documents
from blattwerk.session import new_table_path
from blattwerk.sinks import writers
from blattwerk.sinks.row_files import write_files
from blattwerk.sources import decks, files, records as record_sources
from catalog import inputs
from catalog.decks import conversation_decks
from catalog.pages import paths_below
from catalog.registry import FOLDER, SUFFIX, literal, query, stem, strip

MANIFEST = inputs.with_tables("manifest")


def _in(suffixes: list[str]) -> str:
    return f"{SUFFIX} IN ({', '.join(map(literal, suffixes))})"


KIND = (
    f"CASE WHEN {_in(fixed.IMAGE_SUFFIXES)} THEN 'image' WHEN {_in(fixed.PDF_SUFFIXES)} THEN 'pdf' "
    f"WHEN {_in(fixed.OFFICE_SUFFIXES)} THEN 'office' ELSE 'unsupported' END"
)


@query(
    "scan_documents",
    f"{MANIFEST} SELECT path, {SUFFIX} AS suffix, {KIND} AS kind FROM v_manifest WHERE {KIND} <> 'unsupported'",
)
def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Real files, found by a walk over their folders."""
    path = new_table_path(spark, "documents")
    listing = inputs.manifest(spark, folder)
    write_files(listing.select(F.col("path").alias("name"), F.col("path").alias("text")), path)
    found = files.supported_documents(files.list_files(spark, path, recursive=True))
    return files.sort_documents(found).select(paths_below(path).alias("path"), "suffix", "kind")


@query("classify_documents", f"{MANIFEST} SELECT path, {SUFFIX} AS suffix, {KIND} AS kind FROM v_manifest")
def classify_documents(spark: SparkSession, folder: str) -> DataFrame:
    return files.with_kind(inputs.manifest(spark, folder)).select("path", "suffix", "kind")


@query(
    "select_invoice_files",
    f"{MANIFEST} SELECT path, {FOLDER} AS folder FROM v_manifest WHERE {_in(fixed.PDF_SUFFIXES)}",
)
def select_invoice_files(spark: SparkSession, folder: str) -> DataFrame:
    found = files.sort_documents(files.invoice_files(inputs.manifest(spark, folder)))
    return found.select("path", paths.folder(F.col("path")).alias("folder"))


@query(
    "select_handwriting_files",
    f"{MANIFEST} SELECT path, {FOLDER} AS folder FROM v_manifest WHERE {_in(fixed.HANDWRITING_SUFFIXES)}",
)
def select_handwriting_files(spark: SparkSession, folder: str) -> DataFrame:
    found = files.sort_documents(files.handwriting_files(inputs.manifest(spark, folder)))
    return found.select("path", paths.folder(F.col("path")).alias("folder"))


@query(
    "file_counts",
    f"""{MANIFEST} SELECT {FOLDER} AS folder,
      count(*) FILTER (WHERE {_in(fixed.HANDWRITING_SUFFIXES)}) AS images,
      count(*) FILTER (WHERE {_in(fixed.PDF_SUFFIXES)}) AS pdfs
    FROM v_manifest GROUP BY 1""",
)
def file_counts(spark: SparkSession, folder: str) -> DataFrame:
    return files.file_counts(inputs.manifest(spark, folder))


@query(
    "supported_suffixes",
    f"{MANIFEST} SELECT DISTINCT {SUFFIX} AS suffix, {KIND} AS kind FROM v_manifest WHERE {KIND} <> 'unsupported'",
)
def supported_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return files.supported_suffixes(inputs.manifest(spark, folder))


@query(
    "basename_stem",
    f"{MANIFEST} SELECT path, regexp_extract(path, '[^/]*$') AS name, {stem('path')} AS stem FROM v_manifest",
)
def basename_stem(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    return inputs.manifest(spark, folder).select(
        "path", paths.base_name(path).alias("name"), paths.stem(path).alias("stem")
    )


@query(
    "number_documents",
    f"""{MANIFEST} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS number
    FROM v_manifest""",
)
def documents_numbered(spark: SparkSession, folder: str) -> DataFrame:
    return number_documents(inputs.manifest(spark, folder).select("path"))


@query(
    "sort_documents",
    f"""{MANIFEST} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place
    FROM v_manifest WHERE {KIND} <> 'unsupported'""",
)
def documents_sorted(spark: SparkSession, folder: str) -> DataFrame:
    found = files.supported_documents(inputs.manifest(spark, folder)).select("path")
    placed = number_rows(found, paths.path_order(F.col("path")), "place")
    return files.sort_documents(placed)


@query(
    "page_record_image",
    f"""{MANIFEST} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS page,
      {stem('path')} AS title
    FROM v_manifest WHERE {_in(fixed.HANDWRITING_SUFFIXES)}""",
)
def page_record_image(spark: SparkSession, folder: str) -> DataFrame:
    return image_records(files.handwriting_files(inputs.manifest(spark, folder)).select("path"))


# --- Decks ------------------------------------------------------------------------

LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
DECK_CONTENT = f"array_to_string(list_concat({LINES}, ['Gruppe', 'innen']), chr(10))"
DECK = "'in/deck' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) || '.pptx'"


@query(
    "read_deck_slides",
    f"""SELECT {DECK} AS document, 1 AS page, role || ' ' || CAST(turn AS STRING) AS title,
      {DECK_CONTENT} AS content, 'Notiz ' || CAST(conv_id AS STRING) || chr(10) || 'zwei' AS notes,
      0 AS table_count, greatest(1, length({DECK_CONTENT}) // 4) AS tokens
    FROM conversations
    UNION ALL
    SELECT {DECK}, 2, '', 'Ende', '', 2, 1 FROM conversations""",
)
def read_deck_slides(spark: SparkSession, folder: str) -> DataFrame:
    archives = conversation_decks(inputs.table(spark, folder, "conversations", heavy=True))
    return decks.deck_pages(archives, include_notes=True).select(
        "document", "page", "title", "content", "notes", F.size("tables").alias("table_count"), "tokens"
    )


@query(
    "read_deck_shapes",
    f"""SELECT {DECK} AS document, 1 AS page, {DECK_CONTENT} AS content FROM conversations
    UNION ALL SELECT {DECK}, 2, 'Ende' FROM conversations""",
)
def read_deck_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Decks in files, read by ranges."""
    archives = conversation_decks(inputs.table(spark, folder, "conversations", heavy=True))
    path = new_table_path(spark, "decks")
    write_files(archives.select(F.col("path").alias("name"), F.col("content").alias("text")), path)
    found = decks.file_slides(files.list_files(spark, path, recursive=True)).withColumnRenamed("document", "path")
    return found.select(paths_below(path).alias("document"), "page", decks.shape_text(F.col("texts")).alias("content"))


@query(
    "read_deck_tables",
    f"""SELECT {DECK} AS document, 2 AS page, 1 AS table_no,
      '{{"headers":["' || role || '","turn"],"rows":[["' || CAST(conv_id AS STRING) || '","a\\nb"]]}}' AS table_json
    FROM conversations
    UNION ALL
    SELECT {DECK}, 2, 2, '{{"headers":[],"rows":[["allein"]]}}' FROM conversations""",
)
def read_deck_tables(spark: SparkSession, folder: str) -> DataFrame:
    archives = conversation_decks(inputs.table(spark, folder, "conversations", heavy=True))
    tables = decks.table_structs(F.col("tables"))
    return (
        decks.raw_slides(archives)
        .select("document", "page", F.posexplode(tables).alias("at", "table"))
        .select(
            "document",
            "page",
            (F.col("at") + 1).alias("table_no"),
            records.table_json(F.col("table")).alias("table_json"),
        )
    )


# --- Ground truth and page records ----------------------------------------------------

FILE = (
    "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'in/' END "
    "|| 'rechnung_' || CAST(o_orderkey AS STRING) || '.pdf'"
)


@query(
    "read_ground_truth",
    f"""SELECT {FILE} AS file, k.key AS key,
      CASE k.key WHEN 'Belegnummer' THEN CAST(o_orderkey AS STRING)
        WHEN 'Lieferant' THEN o_orderpriority || ' GmbH'
        WHEN 'Tags' THEN 'x | ' || o_orderstatus ELSE '' END AS value
    FROM orders CROSS JOIN (SELECT unnest(['Belegnummer', 'Lieferant', 'Tags', 'Währung']) AS key) k
    WHERE o_orderkey % 5 <> 0""",
)
def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files that hold objects of up to 1000 orders each, some orders with an empty object."""
    fields = F.concat(
        F.lit('{"Belegnummer": '), F.col("o_orderkey").cast("string"),
        F.lit(', "Lieferant": " '), F.col("o_orderpriority"), F.lit('  GmbH", "Tags": ["x", " ", "'),
        F.col("o_orderstatus"), F.lit(' "], "Währung": null}'),
    )
    member = F.concat(
        F.lit('"'), F.expr(FILE), F.lit('":\n  '),
        F.when(F.expr("o_orderkey % 5 = 0"), F.lit("{}")).otherwise(fields),
    )
    orders = inputs.table(spark, folder, "orders").select(F.expr("o_orderkey DIV 1000").alias("object"), member.alias("member"))
    objects = orders.groupBy("object").agg(F.expr("listagg(member, ',\n ')").alias("members"))
    path = new_table_path(spark, "ground-truth")
    objects.select(F.concat(F.lit("{"), "members", F.lit("}"))).write.text(path)
    return record_sources.read_ground_truth(spark, path)


RECORDS = inputs.with_tables("records")
RECORD_COLUMNS = (
    "method, document, page, title, content, notes, vector_ready_text, round(seconds, 3) AS seconds, tokens, "
    "CASE WHEN page % 4 = 0 THEN 1 ELSE 0 END AS table_count"
)


def _record_columns(pages: DataFrame) -> DataFrame:
    return pages.select(
        "method", "document", "page", "title", "content", "notes", "vector_ready_text", "seconds", "tokens",
        F.size("tables").alias("table_count"),
    )


@query("read_extractions", f"{RECORDS} SELECT {RECORD_COLUMNS} FROM v_records")
def read_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """JSON text lines, read back as page records."""
    path = new_table_path(spark, "extractions")
    rows = inputs.records(spark, folder)
    document = F.concat(F.lit('{"document":"'), F.col("document"), F.lit('",'))
    line = F.concat(document, F.regexp_replace(records.page_json(), r"^\{", ""))
    rows.select(line.alias("value")).write.text(path)
    return _record_columns(record_sources.read_extractions(spark, path))


@query("write_pages_json", f"{RECORDS} SELECT {RECORD_COLUMNS} FROM v_records")
def write_pages_json(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "pages-json")
    writers.write_pages_json(inputs.records(spark, folder), path)
    return _record_columns(record_sources.read_extractions(spark, path))
