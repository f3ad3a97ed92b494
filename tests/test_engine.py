"""Model passes: retries, time limits, blank requests, one load per worker."""

import os
import time

import pytest
from pyspark.sql import functions as F

from blattwerk.operators import requests
from blattwerk.operators.engine import Engine, apply_engine
from blattwerk.plans import runs


def rows_of(spark, texts, partitions=2):
    rows = spark.createDataFrame(
        [("m", f"d{n}", 1, text) for n, text in enumerate(texts)],
        "method string, document string, page int, content string",
    )
    return rows.repartition(partitions)


def ask(rows, engine, **settings):
    asked = rows.withColumn("request", requests.request(F.nullif("content", F.lit(""))))
    return {r.document: r for r in apply_engine(asked, engine, **settings).collect()}


def upper():
    return lambda asked: [request["prompt"].upper() for request in asked]


def test_every_request_has_one_reply(spark):
    found = ask(rows_of(spark, ["a", "", "c"] * 50), Engine("upper", upper), batch_size=7)
    assert len(found) == 150
    assert {found["d0"].reply, found["d1"].reply, found["d2"].reply} == {"A", "", "C"}
    assert all(r.reply_error is None for r in found.values()) and found["d1"].reply_seconds == 0.0


def test_blank_is_not_asked(spark):
    def load():
        def model(asked):
            assert all(request["prompt"] for request in asked)
            return ["x"] * len(asked)

        return model

    assert all(r.reply_error is None for r in ask(rows_of(spark, ["", "", "a"]), Engine("strict", load)).values())


def test_failed_request_keeps_an_error(spark):
    def load():
        def model(asked):
            if any(request["prompt"] == "bad" for request in asked):
                raise RuntimeError("nein")
            return ["ok"] * len(asked)

        return model

    found = ask(rows_of(spark, ["a", "bad", "b"], 1), Engine("picky", load), retries=1)
    assert [found[f"d{n}"].reply for n in range(3)] == ["ok", None, "ok"]
    assert found["d1"].reply_error == "RuntimeError: nein"


def test_retry(spark, tmp_path):
    mark = str(tmp_path / "tried")

    def load():
        def model(asked):
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("erst beim zweiten Mal")
            return ["ok"] * len(asked)

        return model

    found = ask(rows_of(spark, ["a"], 1), Engine("second-try", load), retries=1)
    assert (found["d0"].reply, found["d0"].reply_error) == ("ok", None)


def test_time_limit(spark):
    def load():
        return lambda asked: time.sleep(3) or ["spät"] * len(asked)

    found = ask(rows_of(spark, ["a"], 1), Engine("slow", load), retries=0, timeout=1)
    assert found["d0"].reply is None and found["d0"].reply_error.startswith("TimeoutError")


def test_reply_count_is_checked(spark):
    found = ask(rows_of(spark, ["a"], 1), Engine("mute", lambda: lambda asked: []), retries=0)
    assert "1 Anfragen, 0 Antworten" in found["d0"].reply_error


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(os.path.join(folder, f"{os.getpid()}-{time.time_ns()}"), "w").close()
        return lambda asked: ["x"] * len(asked)

    rows = rows_of(spark, ["a"] * 200, 20)
    ask(rows, Engine("counted", load), batch_size=2)
    ask(rows, Engine("counted", load), batch_size=2)
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 8


def marked(folder, name):
    """Leave a mark, to count calls or loads from outside."""
    open(os.path.join(folder, f"{name}-{os.getpid()}-{time.time_ns()}"), "w").close()


def living(folder):
    """Processes that loaded a model and still run."""
    pids = {int(name.split("-")[1]) for name in os.listdir(folder) if name.startswith("load-")}
    return [pid for pid in pids if os.path.exists(f"/proc/{pid}")]


@pytest.mark.parametrize("one_by_one", [False, True])
def test_model_that_always_hangs(spark, tmp_path, one_by_one):
    folder = str(tmp_path)

    def load():
        marked(folder, "load")

        def model(asked):
            time.sleep(600)
            return ["x"] * len(asked)

        def stream(asked):
            time.sleep(600)
            yield "x"

        return stream if one_by_one else model

    start = time.time()
    found = ask(rows_of(spark, ["a"] * 64, 1), Engine(f"hangs-{one_by_one}", load), timeout=2, retries=2)
    assert time.time() - start < 3 * 2 + 10
    assert {r.reply_error for r in found.values()} == {"TimeoutError: keine Antwort nach 2 s"}
    assert len(os.listdir(folder)) == 3 and not living(folder)


@pytest.mark.parametrize("one_by_one", [False, True])
def test_one_request_hangs(spark, tmp_path, one_by_one):
    folder = str(tmp_path)

    def load():
        marked(folder, "load")

        def answer(request):
            if request["prompt"] == "bad":
                time.sleep(600)
            return request["prompt"].upper()

        return (lambda asked: (answer(r) for r in asked)) if one_by_one else (lambda asked: [answer(r) for r in asked])

    texts = [f"t{n}" for n in range(64)]
    texts[5] = "bad"
    found = ask(rows_of(spark, texts, 1), Engine(f"sticks-{one_by_one}", load), timeout=1, retries=1)
    assert {d: r.reply for d, r in found.items()} == {f"d{n}": None if n == 5 else f"T{n}" for n in range(64)}
    assert found["d5"].reply_error.startswith("TimeoutError") and len(living(folder)) <= 1


def test_limit_is_for_each_reply_of_a_stream(spark):
    def load():
        def model(asked):
            for request in asked:
                time.sleep(0.4)
                yield request["prompt"]

        return model

    found = ask(rows_of(spark, list("abcdef"), 1), Engine("steady", load), timeout=1, retries=0)
    assert [found[f"d{n}"].reply for n in range(6)] == list("abcdef")


def test_a_bad_request_is_found_by_halving(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        def model(asked):
            marked(folder, "call")
            if any(request["prompt"] == "bad" for request in asked):
                raise RuntimeError("nein")
            return [request["prompt"] for request in asked]

        return model

    texts = [f"t{n}" for n in range(64)]
    texts[40] = "bad"
    found = ask(rows_of(spark, texts, 1), Engine("halved", load), retries=2)
    assert [found[f"d{n}"].reply_error for n in range(64)] == [None] * 40 + ["RuntimeError: nein"] + [None] * 23
    assert len(os.listdir(folder)) <= 1 + 2 * 6 + 2


def test_model_that_ends_or_does_not_load(spark, tmp_path):
    def ends():
        def model(asked):
            if any(request["prompt"] == "bad" for request in asked):
                os._exit(3)
            return ["ok"] * len(asked)

        return model

    found = ask(rows_of(spark, ["a", "bad", "b", "c"], 1), Engine("ends", ends), retries=1)
    assert [found[f"d{n}"].reply for n in range(4)] == ["ok", None, "ok", "ok"]
    assert found["d1"].reply_error == "RuntimeError: Modellprozess endete mit 3"

    folder = str(tmp_path)

    def broken():
        marked(folder, "load")
        raise ImportError("kein Modell")

    found = ask(rows_of(spark, ["a", "b", "c", "d"], 1), Engine("broken", broken), retries=1)
    assert {r.reply_error for r in found.values()} == {"ImportError: kein Modell"} and len(os.listdir(folder)) == 3


def test_reply_table(spark, tmp_path):
    """Equal requests are asked once, and a second run asks only what failed."""
    calls, store, mended = tmp_path / "calls", str(tmp_path / "replies"), str(tmp_path / "mended")
    calls.mkdir()

    def load():
        def model(asked):
            for request in asked:
                marked(str(calls), request["prompt"])
            if any(request["prompt"] == "bad" for request in asked) and not os.path.exists(mended):
                raise RuntimeError("nein")
            return [request["prompt"] + "!" for request in asked]

        return model

    def asked_for():
        names = sorted(name.split("-")[0] for name in os.listdir(calls))
        for name in os.listdir(calls):
            os.rename(calls / name, tmp_path / f"seen-{name}")
        return names

    engine, rows = Engine("stored", load), rows_of(spark, ["a", "", "b", "bad", "a", "a"], 3)
    found = ask(rows, engine, replies=store, retries=0, batch_size=1)
    assert [found[f"d{n}"].reply for n in range(6)] == ["a!", "", "b!", None, "a!", "a!"]
    assert found["d3"].reply_error == "RuntimeError: nein" and found["d1"].reply_seconds == 0.0
    assert asked_for() == ["a", "b", "bad"]
    open(mended, "w").close()
    found = ask(rows, engine, replies=store)
    assert [found[f"d{n}"].reply for n in range(6)] == ["a!", "", "b!", "bad!", "a!", "a!"]
    assert all(r.reply_error is None for r in found.values()) and asked_for() == ["bad"]
    assert ask(rows, engine, replies=store) == found and asked_for() == []


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_result_does_not_depend_on_partitions(spark, partitions):
    rows = rows_of(spark, [f"t{n}" for n in range(60)], partitions)
    found = ask(rows, Engine("upper", upper), spread_by=("document", "page"))
    assert {r.document: r.reply for r in found.values()} == {f"d{n}": f"T{n}" for n in range(60)}


def test_rewrite_pass_can_be_switched_off(spark):
    rows = rows_of(spark, ["a"])
    assert runs.vector_ready_pages(rows, None, "powerpoint") is rows
