"""Inputs of the operators, derived from the given tables.

Each function gives a table in Spark; the text of the same name in ``SQL`` is
the same table for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blattwerk.session import spread

SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; for ``heavy`` work per row, spread where it has few splits."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if heavy else rows


def _sql(frame: DataFrame, text: str) -> DataFrame:
    return frame.sparkSession.sql(text, rows=frame)


def _each(frame: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every row once per value."""
    return frame.withColumn(name, F.explode(F.array(*[F.lit(value) for value in values])))


# --- File listing -------------------------------------------------------------

_MANIFEST = """
SELECT doc_id,
       'in/' || source || CASE WHEN doc_id % 7 = 0 THEN '-x/doc' ELSE '/doc' END
         || CAST(doc_id AS STRING)
         || CASE doc_id % 10 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png'
              WHEN 3 THEN '.Jpg' WHEN 4 THEN '.gif' WHEN 5 THEN '.pptx' WHEN 6 THEN '.docx'
              WHEN 7 THEN '.json' WHEN 8 THEN '.tar.pdf' ELSE '' END AS path
FROM {rows}
"""
SQL["manifest"] = _MANIFEST.format(rows="documents")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(table(spark, folder, "documents").select("doc_id", "source"), _MANIFEST)


# --- Page texts of two methods --------------------------------------------------

_PAGES = """
SELECT 'deck' || CAST(conv_id AS STRING) || '.pptx' AS document,
       CAST(turn + 1 AS INT) AS page,
       method,
       CASE (conv_id + turn) % 6
         WHEN 0 THEN '# Titel ' || CAST(conv_id AS STRING) || chr(10) || text
         WHEN 1 THEN 'x' || chr(10) || '**Titel**: Teil ' || CAST(turn AS STRING) || '**' || chr(10) || text
         WHEN 2 THEN '  ' || chr(10)
         WHEN 3 THEN chr(160) || text || chr(9)
         WHEN 4 THEN '=====' || chr(10) || 'BASE: 1' || chr(10) || text
         ELSE text END AS content,
       'source_file=in/deck' || CAST(conv_id AS STRING) || '.pptx' AS notes,
       CAST(length(text) AS DOUBLE) / 8 AS seconds
FROM {rows}
"""
METHODS = ["deepseek-ocr2/vllm/structured", "glm-ocr/glm-ocr/structured"]
SQL["pages"] = _PAGES.format(
    rows="conversations CROSS JOIN (SELECT 'deepseek-ocr2/vllm/structured' AS method "
    "UNION ALL SELECT 'glm-ocr/glm-ocr/structured') m"
)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(_each(table(spark, folder, "conversations", heavy=True), "method", METHODS), _PAGES)


# Full page records: title, stored tokens on every second page, rewritten text on
# two of three pages, and a two-row table made of the page's key.
_RECORDS = """
SELECT *,
       CASE WHEN page % 3 = 0 THEN '' ELSE 'Seite ' || CAST(page AS STRING) END AS title,
       CASE WHEN page % 3 = 1 THEN '' WHEN page % 3 = 2 THEN ' ' ELSE 'Fassung: ' || content END
         AS vector_ready_text,
       CAST(CASE WHEN page % 2 = 0 THEN 0 ELSE length(content) END AS BIGINT) AS tokens
FROM {rows}
"""
SQL["records"] = _RECORDS.format(rows="(" + SQL["pages"] + ") p")


def records(spark: SparkSession, folder: str) -> DataFrame:
    nothing = F.array().cast("array<string>")
    table_struct = F.struct(
        F.array(F.lit("Dokument"), F.lit("Seite")).alias("headers"),
        F.array(F.array(F.col("document"), F.col("page").cast("string"))).alias("rows"),
    )
    return (
        _sql(pages(spark, folder), _RECORDS)
        .withColumn("tables", F.when(F.col("page") % 4 == 0, F.array(table_struct)).otherwise(F.array().cast(
            "array<struct<headers:array<string>,rows:array<array<string>>>>")))
        .withColumn("images_ocr", nothing)
    )


# --- Property replies -----------------------------------------------------------

_REPLIES = """
SELECT document, method, o_orderkey,
       CASE k WHEN 2 THEN '' WHEN 3 THEN 'kein JSON' ELSE
         CASE k WHEN 0 THEN '```json' || chr(10) WHEN 1 THEN 'Ergebnis: ' WHEN 4 THEN '[' ELSE '' END
         || j
         || CASE k WHEN 0 THEN chr(10) || '```' WHEN 1 THEN ' Ende.' WHEN 4 THEN ']' ELSE '' END
       END AS reply
FROM (
  SELECT 'rechnung_' || CAST(o.o_orderkey AS STRING) || '.pdf' AS document,
         o.method, o.o_orderkey, (o.o_orderkey + CASE o.method WHEN 'glm' THEN 1 ELSE 0 END) % 7 AS k,
         '{{"Belegnummer": ' || CAST(o.o_orderkey AS STRING)
           || ', "Lieferant": "  ' || o.o_orderpriority || '   GmbH "'
           || ', "Währung": ' || CASE WHEN o.o_orderkey % 5 = 0 THEN 'null' ELSE '"EUR"' END
           || ', "Tags": ' || CASE WHEN l.n IS NULL THEN 'null' WHEN l.n = 1 THEN '"einzeln"'
                ELSE '["' || l.lo || '", null, " ", "  ' || l.hi || ' x"]' END
           || CASE WHEN o.o_orderkey % 3 = 0 THEN ''
                ELSE ', "Gesamt Betrag": ' || CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING) END
           || ', "Extra": 1}}' AS j
  FROM {orders} o
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS lo, max(l_linestatus) AS hi
             FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
) t
"""
SQL["replies"] = _REPLIES.format(
    orders="(SELECT * FROM orders CROSS JOIN (SELECT 'deepseek' AS method UNION ALL SELECT 'glm') m)",
    lineitem="lineitem",
)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    orders = _each(table(spark, folder, "orders", heavy=True), "method", ["deepseek", "glm"])
    return spark.sql(_REPLIES, orders=orders, lineitem=table(spark, folder, "lineitem"))


# --- Ground truth -----------------------------------------------------------------

_TRUTH = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'in/' END
         || 'rechnung_' || CAST(o_orderkey AS STRING) || '.pdf' AS file,
       key,
       CASE key WHEN 'Belegnummer' THEN CAST(o_orderkey AS STRING)
                WHEN 'Lieferant' THEN lower(o_orderpriority) || ' gmbh'
                WHEN 'Währung' THEN CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'eur' END
                ELSE 'x' END AS value
FROM {rows}
WHERE o_orderkey % 3 <> 1
"""
SQL["truth"] = _TRUTH.format(
    rows="orders CROSS JOIN (SELECT 'Belegnummer' AS key UNION ALL SELECT 'Lieferant' "
    "UNION ALL SELECT 'Währung' UNION ALL SELECT 'Unbekannt') k"
)
TRUTH_KEYS = ["Belegnummer", "Lieferant", "Währung", "Unbekannt"]


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(_each(table(spark, folder, "orders"), "key", TRUTH_KEYS), _TRUTH)


def with_tables(*names: str) -> str:
    """WITH clause that defines the named inputs as ``v_<name>``."""
    return "WITH " + ", ".join(f"v_{name} AS ({SQL[name]})" for name in names) + " "
