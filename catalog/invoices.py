"""Property replies, fill ratios and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blattwerk.fixed import LIST_KEYS, PROPERTY_KEYS
from blattwerk.functions import replies
from blattwerk.operators import invoices, pages as page_ops, requests, scoring
from blattwerk.session import new_table_path, stage
from blattwerk.sinks import writers
from catalog import inputs
from catalog.registry import literal, norm, query, strip

# --- SQL twins of the reply steps ------------------------------------------------

REPLIES = inputs.with_tables("replies") + f""", fenced AS (
    SELECT *, {strip('reply')} AS s FROM v_replies),
  unfenced AS (SELECT *, CASE WHEN starts_with(s, '```')
      THEN regexp_replace(regexp_replace(s, '^```(json)?\\s*', '', 'i'), '\\s*```$', '') ELSE s END AS u FROM fenced),
  blocks AS (SELECT *, CASE WHEN u = '' THEN '{{}}' WHEN json_valid(u) THEN u
      WHEN json_valid(regexp_extract(u, '(?s)\\{{.*\\}}')) THEN regexp_extract(u, '(?s)\\{{.*\\}}') END AS j FROM unfenced),
  parsed AS (SELECT *, CASE WHEN j IS NULL THEN 'Antwort ist kein JSON'
      WHEN json_type(j) <> 'OBJECT' THEN 'Antwort ist kein JSON-Objekt' END AS error FROM blocks) """


def _json_text(key: str) -> str:
    path = literal(f'$."{key}"')
    text = f"json_extract_string(j, {path})"
    number = f"CAST(CAST({text} AS DOUBLE) AS STRING)"
    return f"CASE json_type(j, {path}) WHEN 'DOUBLE' THEN {number} ELSE {text} END"


TAGS = (
    "CASE json_type(j, '$.Tags') WHEN 'ARRAY' THEN list_filter(list_transform("
    f"json_extract_string(j, '$.Tags[*]'), lambda x: {norm('x')}), lambda x: x IS NOT NULL AND x <> '') "
    f"WHEN 'VARCHAR' THEN list_filter([{norm(_json_text('Tags'))}], lambda x: x <> '') ELSE [] END"
)
# The five keys that the replies can hold; the other twelve stay empty.
VALUES = {
    "Belegnummer": f"coalesce({norm(_json_text('Belegnummer'))}, '')",
    "Lieferant": f"coalesce({norm(_json_text('Lieferant'))}, '')",
    "Tags": f"array_to_string({TAGS}, ' | ')",
    "Währung": f"coalesce({norm(_json_text('Währung'))}, '')",
    "Gesamt Betrag": f"coalesce({norm(_json_text('Gesamt Betrag'))}, '')",
}
FIELDS = ", ".join(
    f"CASE WHEN error IS NULL THEN {VALUES.get(key, literal(''))} END AS p{n}" for n, key in enumerate(PROPERTY_KEYS)
)
FILLED = " + ".join(f"CAST(p{n} <> '' AS INT)" for n in range(len(PROPERTY_KEYS)))
ALL_VALUES = " || ' ¦ ' || ".join(f"p{n}" for n in range(len(PROPERTY_KEYS)))
ITEMS = f"""{REPLIES}, props AS (SELECT *, {FIELDS} FROM parsed),
  items AS (SELECT *, {FILLED} AS filled_properties, round(({FILLED}) / CAST(17 AS DOUBLE), 4) AS filled_ratio,
    length(reply) / CAST(8 AS DOUBLE) AS seconds FROM props)"""


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return invoices.parse_replies(inputs.replies(spark, folder))


def items(spark: SparkSession, folder: str) -> DataFrame:
    filled = invoices.invoice_fill(parsed(spark, folder))
    return filled.withColumn("seconds", F.length("reply") / F.lit(8.0))


# --- Replies --------------------------------------------------------------------------

@query("strip_code_fence", f"{REPLIES} SELECT document, method, u AS text FROM parsed")
def strip_code_fence(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.replies(spark, folder).select(
        "document", "method", replies.strip_code_fence(F.col("reply")).alias("text")
    )


@query(
    "extract_json_block",
    f"""{REPLIES} SELECT document, method, j IS NOT NULL AS found,
      json_extract_string(CASE WHEN json_type(j) = 'ARRAY' THEN j->0 ELSE j END, '$.Belegnummer') AS belegnummer FROM parsed""",
)
def extract_json_block(spark: SparkSession, folder: str) -> DataFrame:
    block = replies.extract_json_block(F.col("reply"))
    return (
        inputs.replies(spark, folder)
        .withColumn("block", block)
        .select(
            "document",
            "method",
            F.col("block").isNotNull().alias("found"),
            F.coalesce(
                F.try_variant_get("block", "$.Belegnummer", "string"),
                F.try_variant_get("block", "$[0].Belegnummer", "string"),
            ).alias("belegnummer"),
        )
    )


@query("reject_non_object", f"{REPLIES} SELECT document, method, error FROM parsed")
def reject_non_object(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark, folder).select("document", "method", "error")


@query(
    "coerce_list",
    f"""{REPLIES} SELECT document, method, CAST(len({TAGS}) AS INT) AS count, array_to_string({TAGS}, ';') AS tags
    FROM parsed WHERE error IS NULL""",
)
def coerce_list(spark: SparkSession, folder: str) -> DataFrame:
    good = parsed(spark, folder).where(F.col("error").isNull())
    return good.select(
        "document",
        "method",
        F.size("properties.Tags").alias("count"),
        F.array_join("properties.Tags", ";").alias("tags"),
    )


JSON_FIELDS = " || ',' || ".join(
    f"'\"{key}\":' || " + (
        f"CAST(to_json({TAGS}) AS STRING)" if key == "Tags"
        else "'[]'" if key in LIST_KEYS
        else f"CAST(to_json({VALUES.get(key, literal(''))}) AS STRING)"
    )
    for key in PROPERTY_KEYS
)


@query(
    "coerce_properties",
    f"{REPLIES} SELECT document, method, '{{' || {JSON_FIELDS} || '}}' AS properties FROM parsed WHERE error IS NULL",
)
def coerce_properties(spark: SparkSession, folder: str) -> DataFrame:
    good = parsed(spark, folder).where(F.col("error").isNull())
    return good.select("document", "method", F.to_json("properties").alias("properties"))


ENGINE_REPLY = """SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN '"' || o_orderpriority || '"' WHEN 1 THEN '{{"text": "T ' || o_orderpriority || '"}}'
    WHEN 2 THEN '["' || o_orderstatus || '", 1, null]' WHEN 3 THEN 'null' WHEN 4 THEN '12.50' ELSE 'true' END AS reply,
  '=====' || chr(10) || 'BASE: 1' || chr(10) || o_orderpriority AS log FROM {rows}"""


@query(
    "coalesce_engine_reply",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'T ' || o_orderpriority
      WHEN 2 THEN o_orderstatus || chr(10) || '1' || chr(10) || 'None' WHEN 4 THEN '12.5' WHEN 5 THEN 'True'
      ELSE o_orderpriority END AS text FROM orders""",
)
def coalesce_engine_reply(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql(ENGINE_REPLY, rows=inputs.table(spark, folder, "orders"))
    text = replies.coalesce_engine_reply(F.parse_json("reply"), F.col("log"))
    return rows.select("o_orderkey", text.alias("text"))


@query(
    "empty_property_template",
    inputs.with_tables("pages") + f"""SELECT method, document || '#' || CAST(page AS STRING) AS document, '{{' || chr(10) ||
      {" || ',' || chr(10) || ".join(literal(f'  "{key}": ' + ('[]' if key in LIST_KEYS else '""')) for key in PROPERTY_KEYS)}
      || chr(10) || '}}' AS properties
    FROM v_pages WHERE {strip('content')} = ''""",
)
def empty_property_template(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (here of one page each) without text get the empty properties."""
    single = F.concat("document", F.lit("#"), F.col("page").cast("string"))
    texts = page_ops.document_text(inputs.pages(spark, folder).withColumn("document", single))
    blank = texts.where(F.col("text") == "")
    return blank.select("method", "document", F.lit(replies.empty_property_template()).alias("properties"))


# --- Fill ratio and summaries --------------------------------------------------------------

@query(
    "invoice_fill",
    f"{ITEMS} SELECT document, method, error, filled_properties, filled_ratio FROM items",
)
def invoice_fill(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("document", "method", "error", "filled_properties", "filled_ratio")


@query(
    "invoice_run_summary",
    f"{ITEMS} SELECT count(*) AS total_files, coalesce(round(avg(filled_ratio), 4), 0) AS avg_property_fill_ratio FROM items",
)
def invoice_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return invoices.invoice_run_summary(items(spark, folder))


METHOD_SUMMARY = """SELECT method, count(*) AS total_items, round(sum(seconds), 3) AS total_time_seconds,
  round(sum(seconds) / count(*), 3) AS avg_time_seconds,
  coalesce(round(avg(filled_ratio), 4), 0) AS avg_property_fill_ratio FROM items GROUP BY method"""


@query("invoice_method_summary", f"{ITEMS} {METHOD_SUMMARY}")
def invoice_method_summary(spark: SparkSession, folder: str) -> DataFrame:
    return invoices.invoice_method_summary(items(spark, folder))


@query(
    "write_invoice_run",
    f"""{ITEMS}
    SELECT document, method, filled_properties, filled_ratio, md5({ALL_VALUES}) AS found,
      'invoice_property_extraction' AS task, count(*) OVER () AS total_files,
      round(avg(filled_ratio) OVER (), 4) AS avg_property_fill_ratio FROM items""",
)
def write_invoice_run(spark: SparkSession, folder: str) -> DataFrame:
    """Items and header of a run, written and read back."""
    path = new_table_path(spark, "invoice-run")
    rows = items(spark, folder).select("document", "method", "properties", "filled_properties", "filled_ratio")
    settings = {"task": "invoice_property_extraction", "llm": {"provider": "openai", "model": "(default)"}}
    writers.write_invoice_run(rows, path, settings)
    header = spark.read.schema(
        "total_files bigint, avg_property_fill_ratio double, task string, llm struct<provider:string, model:string>"
    ).json(f"{path}/run").head()
    return spark.read.parquet(f"{path}/items").select(
        "document", "method", "filled_properties", "filled_ratio",
        F.when(F.col("properties").isNotNull(), F.md5(F.array_join(invoices.property_values(" | "), " ¦ "))).alias("found"),
        F.lit(header.task).alias("task"),
        F.lit(header.total_files).cast("bigint").alias("total_files"),
        F.lit(header.avg_property_fill_ratio).alias("avg_property_fill_ratio"),
    )


# --- Scores ---------------------------------------------------------------------------------

def known(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Items with their truth, by file name or path."""
    path = F.concat(F.lit("in/"), F.col("document"))
    return scoring.truth_lookup(
        items(spark, folder).select("document", "method", "properties", *columns),
        inputs.truth(spark, folder),
        F.col("document"),
        path,
    )


TRUTH_KEYS = ["Belegnummer", "Lieferant", "Währung"]
SCORED = ITEMS + f""", {inputs.with_tables('truth')[5:]}, 
  pairs AS (SELECT g.document, g.method, g.error, t.key, trim(t.value) AS truth,
    CASE t.key {' '.join(f"WHEN {literal(k)} THEN p{PROPERTY_KEYS.index(k)}" for k in TRUTH_KEYS)} END AS pred
    FROM items g JOIN v_truth t ON t.file IN (g.document, 'in/' || g.document) WHERE t.key <> 'Unbekannt'),
  scores AS (SELECT *, pred <> '' AND lower(pred) = lower(truth) AS exact_match
    FROM pairs WHERE error IS NULL)"""


@query(
    "truth_lookup",
    f"""{SCORED} SELECT g.document, g.method, count(s.key) > 0 AS found, count(s.key) AS keys,
      max(CASE WHEN s.key = 'Lieferant' THEN truth END) AS lieferant
    FROM items g LEFT JOIN pairs s USING (document, method) GROUP BY g.document, g.method""",
)
def truth_lookup(spark: SparkSession, folder: str) -> DataFrame:
    given = [F.col("truth")[key].isNotNull().cast("bigint") for key in PROPERTY_KEYS]
    return known(spark, folder).select(
        "document",
        "method",
        F.col("truth").isNotNull().alias("found"),
        F.coalesce(sum(given[1:], given[0]), F.lit(0)).alias("keys"),
        F.col("truth.Lieferant").alias("lieferant"),
    )


@query("truth_key_join", f"{SCORED} SELECT document, method, key, pred, truth FROM scores")
def truth_key_join(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.match_by_key(known(spark, folder)).drop("exact_match")


@query("match_by_key", f"{SCORED} SELECT document, method, key, pred, truth, exact_match FROM scores")
def match_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.match_by_key(known(spark, folder))


@query(
    "match_rate",
    f"""{SCORED} SELECT g.document, g.method,
      CAST(CASE WHEN count(s.key) > 0 THEN count(s.key) END AS INT) AS evaluated_fields,
      CAST(CASE WHEN count(s.key) > 0 THEN count(*) FILTER (WHERE exact_match) END AS INT) AS exact_matches,
      round(count(*) FILTER (WHERE exact_match) / CAST(nullif(count(s.key), 0) AS DOUBLE), 4) AS exact_match_rate
    FROM items g LEFT JOIN scores s USING (document, method) GROUP BY g.document, g.method""",
)
def match_rate(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.match_rate(known(spark, folder)).select(
        "document", "method", "evaluated_fields", "exact_matches", "exact_match_rate"
    )
