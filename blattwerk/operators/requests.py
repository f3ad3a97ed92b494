"""Model requests: one struct per call; a null prompt means no call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blattwerk import fixed, schemas
from blattwerk.functions import lookups, replies, text


def request(
    prompt: Column,
    system: Column | str | None = None,
    image: Column | None = None,
    model: Column | str | None = None,
    max_tokens: Column | int = fixed.TEXT_REPLY_TOKENS,
    temperature: Column | float | None = 0.0,
) -> Column:
    def column(value: object) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        column(system).alias("system"),
        prompt.alias("prompt"),
        column(image).alias("image"),
        column(model).alias("model"),
        column(max_tokens).alias("max_tokens"),
        column(temperature).alias("temperature"),
    ).cast(schemas.REQUEST)


def image_payload(content: Column) -> Column:
    """Image bytes as a data URI; the leading bytes tell the kind, PNG where they do not."""
    start = F.hex(F.substring(content, 1, 12))
    kind = F.lit("png")
    for name, signature in fixed.IMAGE_SIGNATURES.items():
        kind = F.when(start.rlike(f"^{signature}"), name).otherwise(kind)
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))


def page_requests(
    pages: DataFrame,
    engine: Column,
    mode: Column,
    image: Column,
    provider: Column | None = None,
    model: Column | None = None,
) -> DataFrame:
    """Adds ``request`` for a page image.

    ``engine`` is ``vision`` (a cloud model with a system prompt), ``deepseek``
    (a batch engine with a longer reply) or ``glm``.
    """
    provider = F.lit("anthropic") if provider is None else provider
    model = F.lit(None).cast("string") if model is None else model
    cloud = engine == "vision"
    batch = engine == "deepseek"
    return pages.withColumn(
        "request",
        request(
            prompt=F.when(cloud, lookups.vision_prompt(mode)).otherwise(
                lookups.engine_prompt(engine, mode)
            ),
            system=F.when(cloud, F.lit(fixed.VISION_SYSTEM_PROMPT)),
            image=image,
            model=F.when(cloud, lookups.resolve_model(provider, model)).when(
                engine == "glm", F.coalesce(model, F.lit(fixed.GLM_MODEL))
            ),
            max_tokens=F.when(batch, fixed.BATCH_REPLY_TOKENS).otherwise(fixed.TEXT_REPLY_TOKENS),
            temperature=F.when(~cloud, F.lit(0.0)),
        ),
    )


def rewrite_requests(pages: DataFrame, source_type: Column, model: Column | None = None) -> DataFrame:
    """Adds ``request`` for the rewrite of page text; blank text asks for nothing."""
    content = text.strip(F.coalesce("content", F.lit("")))
    prompt = F.concat(
        lookups.rewrite_prompt(source_type), F.lit(fixed.REWRITE_SOURCE_HEADING), content
    )
    return pages.withColumn(
        "request",
        request(F.when(content != "", prompt), system=fixed.REWRITE_SYSTEM_PROMPT, model=model),
    )


def property_requests(texts: DataFrame, model: Column | None = None) -> DataFrame:
    """Adds ``request`` for the invoice properties of a document's ``text``."""
    body = text.strip(F.coalesce("text", F.lit("")))
    head = (
        fixed.PROPERTY_PROMPT_HEAD
        + replies.empty_property_template()
        + fixed.PROPERTY_PROMPT_TEXT_HEADING
    )
    return texts.withColumn(
        "request",
        request(
            F.when(body != "", F.concat(F.lit(head), body)),
            system=fixed.PROPERTY_SYSTEM_PROMPT,
            model=model,
        ),
    )
