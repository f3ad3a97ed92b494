"""Large JSON objects read in ranges, against the whole-file parse."""

import json
import random

import pytest
from blattwerk.sources import json_objects, records
from pyspark.sql import functions as F

NASTY = ['"', "\\", "}", "{", "]", "[", ",", ":", "\\\"", "}}", "ä", "€", "\n", "\t", "x y", "", "\\}", '"}', "😀"]


def nasty_object(draw, members):
    def value(depth):
        kind = draw.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return "".join(draw.choice(NASTY) for _ in range(draw.randrange(6)))
        if kind == 2:
            return draw.choice([None, True, 12, 1.5])
        if kind == 3:
            return [value(3) for _ in range(draw.randrange(4))]
        return {"".join(draw.choice(NASTY) for _ in range(3)): value(depth + 1) for _ in range(draw.randrange(4))}

    return {f"f{n}{draw.choice(NASTY)}": draw.choice([value(1), {"Tags": value(2), "Lieferant": value(2)}, {}]) for n in range(members)}


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of ``n`` bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {name: spark.conf.get(name, None) for name in names}

    def cut(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def joined(spark, path):
    """All members in file order, as parsed by the plain parser, the last of a name counting."""
    found = {}
    for r in sorted(json_objects.read_members(spark, str(path)).collect(), key=lambda r: (r.path, r.start, r.place)):
        found.update(json.loads(r.text))
    return found


@pytest.mark.parametrize("size", [90, 1500])
@pytest.mark.parametrize("indent", [None, 1])
def test_members(spark, tmp_path, small_ranges, size, indent):
    want = nasty_object(random.Random(size), 60)
    (tmp_path / "t.json").write_text(json.dumps(want, ensure_ascii=bool(size % 2), indent=indent), encoding="utf-8")
    small_ranges(size)
    assert joined(spark, tmp_path / "t.json") == want


@pytest.mark.parametrize("look", [1, 50])
def test_looks_and_dealt_ranges(spark, tmp_path, small_ranges, monkeypatch, look):
    monkeypatch.setattr(json_objects, "LOOK", look)
    monkeypatch.setattr(json_objects, "BROADCAST_RANGES", 0)
    want = nasty_object(random.Random(look), 40)
    (tmp_path / "t.json").write_text(json.dumps(want, indent=3), encoding="utf-8")
    small_ranges(300)
    assert joined(spark, tmp_path / "t.json") == want


def test_odd_files(spark, tmp_path, small_ranges):
    texts = {
        "empty": "", "blank": " \n ", "none": "{}", "spaced": ' { } ', "number": "12", "null": "null", "list": "[1, 2]",
        "lines": '{"a": {"k": "1"}}\n{}\n{"b": {"k": "2"}}\n', "flat": '{"c": 1, "d": null, "e": {"k": "3"}, "f": "}", "g": []}',
        "early": '{"h": {"k": "4"}, "i": {"k": "',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    for size in (11, 1000):
        small_ranges(size)
        rows = records.read_ground_truth(spark, str(tmp_path)).collect()
        assert sorted((r.file, r.value) for r in rows) == [("a", "1"), ("b", "2"), ("e", "3"), ("h", "4")]


def test_one_file_over_many_tasks(spark, tmp_path, small_ranges):
    truth = {f"r{n}.pdf": {"Belegnummer": n, "Tags": ["x", f"}}{n}"], "Lieferant": '"{' * (n % 5)} for n in range(3000)}
    text = json.dumps(truth, ensure_ascii=False)
    # A repeated name: the last one counts.
    text = '{"r7.pdf": {"Belegnummer": -1}, ' + text[1:]
    (tmp_path / "t.json").write_text(text, encoding="utf-8")
    small_ranges(9000)
    rows = records.read_ground_truth(spark, str(tmp_path / "t.json"))
    whole = records.truth_from_json(spark.createDataFrame([(json.dumps(truth, ensure_ascii=False),)], "value string"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))
    assert json_objects._pieces(spark, str(tmp_path / "t.json")).select(F.spark_partition_id()).distinct().count() > 10
