"""Replies, properties and scores on edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from blattwerk.fixed import LIST_KEYS, PROPERTY_KEYS
from blattwerk.functions import replies
from blattwerk.operators import invoices, scoring

NO_JSON, NO_OBJECT = "Antwort ist kein JSON", "Antwort ist kein JSON-Objekt"


def parsed(spark, reply):
    rows = spark.createDataFrame([(reply,)], "reply string")
    return invoices.parse_replies(rows).head()


@pytest.mark.parametrize(
    "reply, error, number",
    [
        ('```json\n{"Belegnummer":1}\n```', None, "1"),
        ('```JSON {"Belegnummer":"2"}```', None, "2"),
        ('Hier: {"Belegnummer":3} fertig', None, "3"),
        ("", None, ""),
        (" \n", None, ""),
        (None, None, ""),
        ("kein JSON", NO_JSON, None),
        ("} {", NO_JSON, None),
        ("```\n```", NO_JSON, None),
        ("[1,2]", NO_OBJECT, None),
        ("null", NO_OBJECT, None),
        ('"x"', NO_OBJECT, None),
        ('{"Belegnummer":4,"Belegnummer":5}', None, "5"),
    ],
)
def test_reply(spark, reply, error, number):
    row = parsed(spark, reply)
    assert row.error == error
    assert (row.properties and row.properties["Belegnummer"]) == number


@pytest.mark.parametrize(
    "value",
    ["150.00", "12.50", "0.00", "-3.10", "5", "-7", "1e3", "1.5e-7", "1e20", "1.5e+100", "1e7", "true", "false",
     '"x"', "112946.26", "123456789012"],
)
def test_scalar_text_is_that_of_python(one, value):
    assert one(replies.scalar_text(F.parse_json(F.lit(value)))) == str(json.loads(value))


@pytest.mark.parametrize(
    "value, texts",
    [("null", []), ('["a",null," b  c "," "]', ["a", "b c"]), ('"x"', ["x"]), ('" "', []), ("7", ["7"]), ("[]", [])],
)
def test_coerce_list(one, value, texts):
    assert one(replies.coerce_list(F.parse_json(F.lit(value)))) == texts


def test_only_known_keys(spark):
    row = parsed(spark, '{"Extra":1}')
    assert row.properties.asDict() == {k: [] if k in LIST_KEYS else "" for k in PROPERTY_KEYS}
    assert json.loads(replies.empty_property_template()) == row.properties.asDict()


@pytest.mark.parametrize("filled, ratio", [(0, 0.0), (5, 0.2941), (17, 1.0)])
def test_fill(spark, filled, ratio):
    reply = json.dumps({key: ["x"] if key in LIST_KEYS else "x" for key in PROPERTY_KEYS[:filled]})
    rows = invoices.parse_replies(spark.createDataFrame([(reply,)], "reply string"))
    row = invoices.invoice_fill(rows).head()
    assert (row.filled_properties, row.filled_ratio) == (filled, ratio)


def test_fill_of_failed_reply_is_unknown(spark):
    rows = spark.createDataFrame([("a", "kein JSON"), ("b", '{"Belegnummer":1}')], "document string, reply string")
    items = invoices.invoice_fill(invoices.parse_replies(rows))
    assert items.where("document = 'a'").head().filled_ratio is None
    summary = invoices.invoice_run_summary(items).head()
    assert (summary.total_files, summary.avg_property_fill_ratio) == (2, 0.0588)
    assert invoices.invoice_run_summary(items.limit(0)).head().avg_property_fill_ratio == 0.0


def test_long_form(spark):
    rows = invoices.parse_replies(spark.createDataFrame([('{"Tags":["a","b"]}',)], "reply string"))
    long = {r.key: r.value for r in invoices.property_rows(rows.select("properties")).collect()}
    assert list(long) == PROPERTY_KEYS and long["Tags"] == "a | b"


def scored(spark, reply, truth, document="in/a.pdf"):
    items = invoices.parse_replies(spark.createDataFrame([(document, reply)], "document string, reply string"))
    rows = spark.createDataFrame(truth, "file string, key string, value string")
    name = F.substring_index("document", "/", -1)
    return scoring.truth_lookup(items, rows, name, F.col("document"))


def test_match(spark):
    truth = [("a.pdf", "Währung", " eur"), ("a.pdf", "Kategorie", ""), ("a.pdf", "Unbekannt", "x"),
             ("a.pdf", "Tags", "A | b")]
    frame = scored(spark, '{"Währung":"EUR","Tags":["a","B"]}', truth)
    found = {r.key: (r.pred, r.truth, r.exact_match) for r in scoring.match_by_key(frame).collect()}
    assert found == {
        "Währung": ("EUR", "eur", True), "Kategorie": ("", "", False), "Tags": ("a | B", "A | b", True),
    }
    rate = scoring.match_rate(frame).head()
    assert (rate.evaluated_fields, rate.exact_matches, rate.exact_match_rate) == (3, 2, 0.6667)


def test_truth_without_known_key(spark):
    rate = scoring.match_rate(scored(spark, "{}", [("a.pdf", "Unbekannt", "x")])).head()
    assert (rate.evaluated_fields, rate.exact_matches, rate.exact_match_rate) == (0, 0, None)


def test_no_truth(spark):
    rate = scoring.match_rate(scored(spark, "{}", [("b.pdf", "Währung", "x")])).head()
    assert (rate.evaluated_fields, rate.exact_match_rate) == (None, None)


def test_name_before_path(spark):
    both = [("a.pdf", "Währung", "n"), ("in/a.pdf", "Währung", "p")]
    assert scored(spark, "{}", both).head().truth["Währung"] == "n"
    assert scored(spark, "{}", both[1:]).head().truth["Währung"] == "p"
