"""Operators in a session whose workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession

spark = (SparkSession.builder.master("local[2]")
         .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from llm import centroids, decontamination, token_counts

docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
items = spark.createDataFrame([("a", "two three")], "item_id string, text string")
assert sorted(map(tuple, token_counts.document_tokens(docs).collect())) == [(1, 3), (2, 0)]
found = decontamination.contaminated(docs, items, automaton_bytes=1).orderBy("doc_id").collect()
assert [(r.doc_id, r.n_hit) for r in found] == [(1, 2), (2, 0)]
vectors = spark.createDataFrame([(n, [float(n), 0.0]) for n in range(4)], "vec_id long, embedding array<float>")
assert centroids.clusters_of(vectors, clusters=2, dimensions=2).count() == 4
print("all well")
"""


def test_workers_without_the_package(tmp_path):
    """The driver finds the package by a path of its own; workers start in an empty folder without it."""
    root = str(Path(__file__).resolve().parents[2])
    (tmp_path / "empty").mkdir()
    code = SCRIPT.format(root=root, shared=str(tmp_path / "shared"))
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path / "empty", env=environment, capture_output=True, text=True, timeout=300
    )
    assert "all well" in done.stdout, done.stderr[-3000:]
