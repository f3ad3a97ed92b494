"""Register of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blattwerk.session import prepare, ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship("catalog")
            return function(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# --- Pieces of the SQL twins ---------------------------------------------------

# White space, spelled out because the engine's own class is smaller.
WS = (
    r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(column: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {literal(default)} END"


SUFFIX = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
FOLDER = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"


def stem(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    return f"regexp_replace({name}, '^(.+)\\.[^./]+$', '\\1')"


def base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"
