"""Model replies: from raw text to typed invoice properties."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from blattwerk.fixed import LIST_KEYS, PROPERTY_KEYS
from blattwerk.functions.text import clean_engine_log, norm_space, strip


# A reply inside a code fence; the fence may be tagged and may lack its end.
FENCED = r"(?isU)\A```(?:json)?[\s\x1c-\x1f]*+(.*?)(?:[\s\x1c-\x1f]*+```)?\z"


def strip_code_fence(reply: Column) -> Column:
    """Reply without white space around it and without a surrounding code fence."""
    return _unfenced(strip(reply))


def _unfenced(text: Column) -> Column:
    return F.when(text.startswith("```"), F.regexp_replace(text, FENCED, "$1")).otherwise(text)


def json_text(stripped: Column) -> Column:
    """The part of a stripped reply that should be JSON; without text, the empty object."""
    blank = F.coalesce(stripped, F.lit("")) == ""
    return F.when(blank, F.lit("{}")).otherwise(_unfenced(stripped))


def parse_json_block(text: Column) -> Column:
    """Variant of the JSON text, or of its first opening to its last closing brace."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(block))


def extract_json_block(reply: Column) -> Column:
    """Variant of the JSON in a reply; null where there is none."""
    return parse_json_block(json_text(strip(reply)))


def reply_fields(parsed: Column) -> Column:
    """Top-level fields of a parsed reply as a map; null if it is no object."""
    return F.try_variant_get(parsed, "$", "map<string,variant>")


def reply_error(parsed: Column, fields: Column) -> Column:
    """Why a reply gives no properties; null where it does."""
    return F.when(parsed.isNull(), F.lit("Antwort ist kein JSON")).when(
        fields.isNull(), F.lit("Antwort ist kein JSON-Objekt")
    )


def _float_text(text: Column) -> Column:
    """Text of a double: plain from 0.0001 below 1e16, else like ``1.5e-07``."""
    size = F.abs(text.cast("double"))
    plain = F.rtrim(text.cast("decimal(38,18)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2))
    digits = F.regexp_replace(power, "-", "")
    digits = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    short = F.concat(mantissa, F.when(power.startswith("-"), "e-").otherwise("e+"), digits)
    return (
        F.when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(short)
    )


def scalar_text(value: Column) -> Column:
    """Text of a JSON value: ``12.5``, ``150.0`` for 150.00, ``True``; null for null.

    Objects and lists give their JSON text.
    """
    # Kind and text are worked out once per value, in an array of one struct;
    # texts and plain whole numbers, nearly all values, end at the first test.
    # Whole numbers up to 18 digits are BIGINT, so a short DECIMAL without
    # decimals was written with a decimal point.
    seen = F.array(
        F.struct(
            F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text")
        )
    )
    return F.get(
        F.transform(
            seen,
            lambda v: F.when((v["kind"] == "STRING") | (v["kind"] == "BIGINT"), v["text"])
            .when(v["kind"] == "BOOLEAN", F.initcap(v["text"]))
            .when(v["kind"].rlike(r"^DECIMAL\((?:[1-9]|1[0-8]),0\)"), F.concat(v["text"], F.lit(".0")))
            .when(v["kind"] == "DOUBLE", _float_text(v["text"]))
            .otherwise(v["text"]),
        ),
        F.lit(0),
    )


def coalesce_engine_reply(reply: Column, log: Column) -> Column:
    """Text of an engine reply that may be a text, an object with ``text``, a
    list or something else; without a reply, the cleaned console log."""
    kind = F.schema_of_variant(reply)
    inner = F.try_variant_get(reply, "$.text", "variant")
    items = F.transform(
        F.try_variant_get(reply, "$", "array<variant>"),
        lambda item: F.coalesce(scalar_text(item), F.lit("None")),
    )
    return (
        F.when(reply.isNull() | F.is_variant_null(reply), clean_engine_log(log))
        .when(kind.startswith("OBJECT") & inner.isNotNull(), scalar_text(inner))
        .when(kind.startswith("ARRAY"), F.array_join(items, "\n"))
        .otherwise(scalar_text(reply))
    )


def coerce_list(value: Column) -> Column:
    """Normalised texts of a list, or of a single value; never null."""
    nothing = F.array().cast("array<string>")
    items = F.when(
        F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    ).otherwise(F.array(value))
    texts = F.transform(items, lambda item: norm_space(scalar_text(item)))
    kept = F.filter(texts, lambda text: text.isNotNull() & (text != ""))
    return F.when(value.isNull(), nothing).otherwise(F.coalesce(kept, nothing))


def coerce_scalar(value: Column) -> Column:
    text = F.coalesce(norm_space(scalar_text(value)), F.lit(""))
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def coerce_properties(fields: Column) -> Column:
    """Values of exactly the 17 known keys, as (texts, lists); missing ones are
    empty, others dropped. ``property_struct`` gives them their names.

    One lambda serves all keys of a kind, so that the expression stays small.
    """
    scalar_keys = [key for key in PROPERTY_KEYS if key not in LIST_KEYS]

    def values(keys: list[str]) -> Column:
        return F.array(*[F.try_element_at(fields, F.lit(key)) for key in keys])

    return F.struct(
        F.transform(values(scalar_keys), coerce_scalar).alias("texts"),
        F.transform(values(LIST_KEYS), coerce_list).alias("lists"),
    )


def property_struct(name: str) -> Column:
    """The coerced values in column ``name`` as one field per key."""
    scalar_keys = [key for key in PROPERTY_KEYS if key not in LIST_KEYS]
    fields = [
        f"'{key}', get({name}.lists, {LIST_KEYS.index(key)})"
        if key in LIST_KEYS
        else f"'{key}', get({name}.texts, {scalar_keys.index(key)})"
        for key in PROPERTY_KEYS
    ]
    return F.expr(f"named_struct({', '.join(fields)})")


def empty_property_template() -> str:
    """JSON text of the 17 keys without values, as it stands in the prompt."""
    return json.dumps(
        {key: [] if key in LIST_KEYS else "" for key in PROPERTY_KEYS}, ensure_ascii=False, indent=2
    )
