"""Text functions. White space means the 29 characters that Unicode and the
ASCII separators 0x1C-0x1F make up, not just the blank."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set, and the line breaks among it, inside a Java character class.
SPACE = r"\s\x1c-\x1f"
LINE_BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def norm_space(text: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.shiftright(F.length(text), 2)).cast("bigint")


def stored_or_estimated_tokens(tokens: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(tokens, F.lit(0)), estimate_tokens(text))


def join_parts(parts: Column, separator: str = "\n") -> Column:
    """Strip the parts, drop blank ones, join the rest."""
    stripped = F.transform(parts, strip)
    return F.array_join(F.filter(stripped, lambda part: part != ""), separator)


def normalize_list(parts: Column) -> Column:
    """Normalised parts without nulls and blanks."""
    return F.filter(F.transform(parts, norm_space), lambda part: part != "")


def normalize_value(value: Column, is_list: bool = False) -> Column:
    """Comparable text of a property value; a list becomes ``a | b``."""
    if is_list:
        return F.coalesce(F.array_join(normalize_list(value), " | "), F.lit(""))
    return F.coalesce(norm_space(value), F.lit(""))


def markdown_title(text: Column) -> Column:
    """Title of a Markdown page.

    The first line that opens with ``# `` or ``**Titel`` decides: the first
    kind gives the rest of the line, the second the part after its first colon
    without surrounding asterisks, or nothing if it has no colon.
    """
    line = strip(
        F.regexp_extract(
            text,
            rf"(?dmU)^[{SPACE}&&[^\n]]*+"
            rf"(# (?=[^\n]*[^{SPACE}])[^\n]*|\*\*Titel[^\n]*)",
            1,
        )
    )
    after_colon = F.btrim(strip(F.regexp_extract(line, r"(?s):(.*)$", 1)), F.lit("*"))
    return F.when(line.startswith("# "), strip(F.substr(line, F.lit(3)))).otherwise(after_colon)


def source_from_notes(notes: Column) -> Column:
    """Path on the first ``source_file=`` line, or the empty text."""
    return F.coalesce(
        strip(
            F.regexp_extract(
                notes, rf"(?U)(?:\A|[{LINE_BREAK}])[{SPACE}]*+source_file=([^{LINE_BREAK}]*)", 1
            )
        ),
        F.lit(""),
    )


def clean_engine_log(log: Column) -> Column:
    """Page text out of an engine's console log, technical lines removed."""
    lines = F.regexp_replace(strip(log), rf"\r\n|[{LINE_BREAK}]", "\n")
    kept = F.regexp_replace(
        lines,
        rf"(?dmU)^[{SPACE}&&[^\n]]*+(?:=+[{SPACE}&&[^\n]]*+|(?:BASE|PATCHES):[^\n]*+)(?:\n|\z)",
        "",
    )
    return strip(F.regexp_replace(kept, rf"(?dmU)^[{SPACE}&&[^\n]]++$", ""))


def fallback_text(vector_ready_text: Column, content: Column, placeholder: str) -> Column:
    """The rewritten text if there is any, even a blank one, or else the page's own."""
    shown = strip(F.coalesce(F.nullif(vector_ready_text, F.lit("")), content, F.lit("")))
    return F.when(shown == "", F.lit(placeholder)).otherwise(shown)


def page_label(title: Column, page: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Slide "), page.cast("string")))


def fixed_decimals(number: Column, places: int) -> Column:
    """Number as text; rounded first, so that ties do not depend on the formatter."""
    return F.format_string(f"%.{places}f", F.round(number.cast("double"), places))


def page_bounds(spec: Column) -> Column:
    """First and last page of each part of a list such as ``1,3,5-10``; never longer than the list.

    A range that runs downwards holds no page, nor does a part that is no number;
    ``page_range_error`` names those.
    """
    parts = F.transform(F.split(spec, ","), strip)
    bounds = F.transform(
        parts,
        lambda part: F.struct(
            strip(F.split_part(part, F.lit("-"), F.lit(1))).try_cast("int").alias("first"),
            strip(
                F.when(part.contains("-"), F.regexp_replace(part, r"^[^-]*-", "")).otherwise(part)
            ).try_cast("int").alias("last"),
        ),
    )
    return F.filter(bounds, lambda b: b["first"] <= b["last"])


def page_range(spec: Column, last: Column | None = None) -> Column:
    """Page numbers in a list such as ``1,3,5-10``, ascending, each once.

    Every number is written out, up to ``last`` where that is given (the pages that a
    document has); to choose pages use ``page_bounds``, which writes none out.
    """
    bounds = page_bounds(spec)
    if last is not None:
        bounds = F.transform(bounds, lambda b: F.struct(b["first"].alias("first"), F.least(b["last"], last).alias("last")))
        bounds = F.filter(bounds, lambda b: b["first"] <= b["last"])
    numbers = F.flatten(F.transform(bounds, lambda b: F.sequence(b["first"], b["last"])))
    return F.array_sort(F.array_distinct(numbers))


def page_range_error(spec: Column) -> Column:
    """The first part of a page list that is neither a number nor a range, or null."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda part: ~part.rlike(r"^\d+\s*(-\s*\d+)?$"))
    return F.get(parts, F.lit(0))
