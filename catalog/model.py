"""Requests and model passes, with a deterministic stand-in for the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blattwerk import fixed
from blattwerk.functions import replies
from blattwerk.operators import pages as page_ops, requests
from blattwerk.operators.engine import Engine, Model, apply_engine
from blattwerk.plans import runs
from catalog import inputs
from catalog.pages import MODEL, ORDERS, VISION, _prompt_case
from catalog.registry import literal, query, strip

PAGES = inputs.with_tables("pages")
KEYS = ["method", "document", "page"]


def _load_quoting() -> Model:
    """Answers with the prompt itself, every line quoted."""

    def answer(asked: list[dict]) -> list[str]:
        return ["> " + request["prompt"].replace("\n", "\n> ") for request in asked]

    return answer


def _load_faulty() -> Model:
    """Refuses a batch that holds a prompt with an ``x`` line."""

    def answer(asked: list[dict]) -> list[str]:
        if any("\nx\n" in request["prompt"] for request in asked):
            raise RuntimeError("keine Antwort")
        return [str(len(request["prompt"])) for request in asked]

    return answer


def _load_invoice() -> Model:
    """Answers a property prompt with a fenced reply about the text's length."""

    def answer(asked: list[dict]) -> list[str]:
        return [
            '```json\n{"Belegnummer": %d, "Tags": ["a", " "]}\n```' % len(request["prompt"]) for request in asked
        ]

    return answer


QUOTING = Engine("quoting", _load_quoting)
FAULTY = Engine("faulty", _load_faulty)
INVOICE = Engine("invoice", _load_invoice)


@query(
    "build_page_requests",
    f"""WITH s AS ({ORDERS.format(rows='orders')}),
      e AS (SELECT *, CASE WHEN o_orderkey % 6 = 5 THEN 'vision' ELSE engine END AS kind FROM s)
    SELECT o_orderkey, kind,
      CASE WHEN kind = 'vision' THEN {literal(fixed.VISION_SYSTEM_PROMPT)} END AS system,
      CASE WHEN kind = 'vision' THEN {VISION} ELSE {_prompt_case()} END AS prompt,
      'data:image/png;base64,' || base64(encode(provider || mode)) AS image,
      CASE kind WHEN 'vision' THEN {MODEL} WHEN 'glm' THEN coalesce(model, 'glm-ocr') END AS model,
      CASE WHEN kind = 'deepseek' THEN 8192 ELSE 4096 END AS max_tokens,
      CASE WHEN kind <> 'vision' THEN CAST(0 AS DOUBLE) END AS temperature
    FROM e""",
)
def build_page_requests(spark: SparkSession, folder: str) -> DataFrame:
    settings = spark.sql(ORDERS, rows=inputs.table(spark, folder, "orders"))
    kind = F.when(F.expr("o_orderkey % 6 = 5"), "vision").otherwise(F.col("engine"))
    image = requests.image_payload(F.encode(F.concat("provider", "mode"), "UTF-8"))
    asked = requests.page_requests(
        settings.withColumn("kind", kind), F.col("kind"), F.col("mode"), image, F.col("provider"), F.col("model")
    )
    return asked.select("o_orderkey", "kind", "request.*")


BODY = strip("content")
REWRITE = (
    f"CASE WHEN page % 2 = 0 THEN {literal(fixed.REWRITE_POWERPOINT_PROMPT)} "
    f"ELSE {literal(fixed.REWRITE_HANDWRITING_PROMPT)} END || chr(10) || chr(10) || 'Quelltext:' || chr(10) || {BODY}"
)
SOURCE_TYPE = "CASE WHEN page % 2 = 0 THEN 'powerpoint' ELSE 'handwriting' END"


@query(
    "build_rewrite_requests",
    f"""{PAGES} SELECT method, document, page, {literal(fixed.REWRITE_SYSTEM_PROMPT)} AS system,
      CASE WHEN {BODY} <> '' THEN {REWRITE} END AS prompt, 4096 AS max_tokens FROM v_pages""",
)
def build_rewrite_requests(spark: SparkSession, folder: str) -> DataFrame:
    asked = requests.rewrite_requests(inputs.pages(spark, folder), F.expr(SOURCE_TYPE))
    return asked.select(*KEYS, "request.system", "request.prompt", "request.max_tokens")


TEXTS = f"""{PAGES}, texts AS (SELECT method, document, count(*) AS pages,
    coalesce(string_agg(content, chr(10) || chr(10) ORDER BY page) FILTER (WHERE {BODY} <> ''), '') AS text
    FROM v_pages GROUP BY method, document)"""
PROPERTY_HEAD = literal(
    fixed.PROPERTY_PROMPT_HEAD + replies.empty_property_template() + fixed.PROPERTY_PROMPT_TEXT_HEADING
)


@query(
    "build_property_requests",
    f"""{TEXTS} SELECT method, document, pages, {literal(fixed.PROPERTY_SYSTEM_PROMPT)} AS system,
      CASE WHEN {strip('text')} <> '' THEN {PROPERTY_HEAD} || {strip('text')} END AS prompt FROM texts""",
)
def build_property_requests(spark: SparkSession, folder: str) -> DataFrame:
    texts = page_ops.document_text(inputs.pages(spark, folder))
    asked = requests.property_requests(texts)
    return asked.select("method", "document", "pages", "request.system", "request.prompt")


QUOTED = f"CASE WHEN {BODY} = '' THEN '' ELSE '> ' || replace({REWRITE}, chr(10), chr(10) || '> ') END"


@query("apply_engine", f"{PAGES} SELECT method, document, page, {QUOTED} AS reply FROM v_pages")
def engine_pass(spark: SparkSession, folder: str) -> DataFrame:
    asked = requests.rewrite_requests(inputs.pages(spark, folder), F.expr(SOURCE_TYPE))
    answered = apply_engine(asked.select(*KEYS, "request"), QUOTING, spread_by=tuple(KEYS))
    return answered.select(*KEYS, "reply")


FAILED = f"contains({REWRITE}, chr(10) || 'x' || chr(10)) AND {BODY} <> ''"


@query(
    "retry_engine",
    f"""{PAGES} SELECT method, document, page,
      CASE WHEN {FAILED} THEN NULL WHEN {BODY} = '' THEN '' ELSE CAST(length({REWRITE}) AS STRING) END AS reply,
      CASE WHEN {FAILED} THEN 'RuntimeError: keine Antwort' END AS error FROM v_pages""",
)
def retry_engine(spark: SparkSession, folder: str) -> DataFrame:
    """A model that fails on some pages: those keep an error, all others their reply."""
    asked = requests.rewrite_requests(inputs.pages(spark, folder), F.expr(SOURCE_TYPE))
    answered = apply_engine(asked.select(*KEYS, "request"), FAULTY, batch_size=8, retries=1, timeout=30)
    return answered.select(*KEYS, "reply", F.col("reply_error").alias("error"))


@query(
    "vector_ready_pages",
    f"{PAGES} SELECT method, document, page, content, {QUOTED} AS vector_ready_text FROM v_pages",
)
def vector_ready_pages(spark: SparkSession, folder: str) -> DataFrame:
    rewritten = runs.vector_ready_pages(inputs.pages(spark, folder), QUOTING, F.expr(SOURCE_TYPE))
    return rewritten.select(*KEYS, "content", "vector_ready_text")


@query(
    "invoice_properties",
    f"""{TEXTS}, asked AS (SELECT *, {strip('text')} AS body FROM texts)
    SELECT method, document, pages, text AS ocr_text,
      CASE WHEN body = '' THEN '' ELSE CAST(length({PROPERTY_HEAD} || body) AS STRING) END AS belegnummer,
      CASE WHEN body = '' THEN '' ELSE 'a' END AS tags,
      CASE WHEN body = '' THEN 0 ELSE 2 END AS filled_properties,
      CASE WHEN body = '' THEN 0 ELSE CAST(0.1176 AS DOUBLE) END AS filled_ratio
    FROM asked""",
)
def invoice_properties(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.invoice_properties(inputs.pages(spark, folder), INVOICE)
    return found.select(
        "method", "document", "pages", "ocr_text",
        F.col("properties.Belegnummer").alias("belegnummer"),
        F.array_join("properties.Tags", ";").alias("tags"),
        "filled_properties", "filled_ratio",
    )
