"""Look-ups in the small fixed tables, as literal CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from blattwerk import fixed


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    result = F.lit(default)
    for name, value in table.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def engine_prompt(engine: Column, mode: Column) -> Column:
    """Prompt of a local engine; an unknown mode gets the structured one.

    ``easyocr`` reads an image without one: its prompt is the empty text.
    """
    deepseek, glm = fixed.DEEPSEEK_PROMPTS, fixed.GLM_PROMPTS
    return F.when(engine == "deepseek", lookup(mode, deepseek, deepseek["structured"])).when(
        engine == "glm", lookup(mode, glm, glm["structured"])
    ).when(engine == "easyocr", F.lit(""))


def vision_prompt(mode: Column) -> Column:
    return lookup(mode, {"invoice": fixed.VISION_INVOICE_PROMPT}, fixed.VISION_SLIDE_PROMPT)


def rewrite_prompt(source_type: Column) -> Column:
    return lookup(
        source_type, {"powerpoint": fixed.REWRITE_POWERPOINT_PROMPT}, fixed.REWRITE_HANDWRITING_PROMPT
    )


def resolve_model(provider: Column, model: Column) -> Column:
    """The given model, or the provider's default where none (or an empty one) is given."""
    default = lookup(provider, fixed.DEFAULT_MODELS, fixed.FALLBACK_MODEL)
    return F.coalesce(F.nullif(model, F.lit("")), default)


def engine_mode(engine: Column, input_kind: Column, mode: Column) -> Column:
    """Mode an engine runs in, for a benchmark of decks, PDFs or images in ``mode``."""
    pages = F.when(mode == "markdown", "markdown").otherwise("structured")
    first = F.when(mode.isin("slide", "invoice"), F.lit("structured")).otherwise(mode)
    second = F.when(mode == "invoice", "invoice").otherwise("structured")
    return F.when(input_kind != "image", pages).when(engine == "deepseek", first).otherwise(second)


def method_label(engine: Column, provider: Column, model: Column, mode: Column) -> Column:
    """Label under which a run's records and results stand.

    ``model`` is the model of ``vision`` and ``glm`` (null or empty for the
    default) and the backend of ``deepseek`` (likewise). Other engines are their own label.
    """
    backend = F.coalesce(F.nullif(model, F.lit("")), F.lit(fixed.DEEPSEEK_BACKEND))
    served = F.coalesce(F.nullif(model, F.lit("")), F.lit(fixed.GLM_MODEL))
    return (
        F.when(engine == "vision", F.concat(F.lit("vision-"), provider, F.lit("/"), resolve_model(provider, model)))
        .when(engine == "deepseek", F.concat_ws("/", F.lit("deepseek-ocr2"), backend, mode))
        .when(engine == "glm", F.concat_ws("/", F.lit("glm-ocr"), served, mode))
        .when(engine == "easyocr", F.lit("easyocr-local"))
        .otherwise(engine)
    )


def cost_per_page(method: Column, costs: Mapping[str, float] = fixed.COST_PER_PAGE) -> Column:
    """Cost of the first key that occurs in the method label, or 0."""
    result = F.lit(0.0)
    for key, cost in reversed(list(costs.items())):
        result = F.when(F.contains(method, F.lit(key)), F.lit(float(cost))).otherwise(result)
    return result


def invalid_methods(asked: Column, allowed: list[str] = fixed.METHODS) -> Column:
    """Names that are not allowed, ascending, each once."""
    return F.array_sort(F.array_except(asked, F.array(*[F.lit(name) for name in allowed])))


def method_order(method: Column, order: list[str] | None = None) -> Column:
    """Place of a method label in the given order, or the fixed one; unknown ones come last."""
    names = order or fixed.METHODS
    place = F.lit(len(names) + 1)
    for number, name in reversed(list(enumerate(names, start=1))):
        place = F.when(method.startswith(name), F.lit(number)).otherwise(place)
    return place
