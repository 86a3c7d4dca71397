"""Operators on groups that hold a large share of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import decontam, kd_shard, preference, quality_mil, simhash
from engram.shared import written

from .test_llm import OP7, OP10, brute_contamination, brute_preferences, dealt_right, rows_of


@pytest.mark.parametrize("name", [None, 5])
def test_shards_of_one_repeated_id(spark, name):
    """Half of the bytes are one text under null ids, or under one id."""
    rows = [(name, "x" * 100)] * 2000 + [(i + 10, f"text number {i:06d} " + "y" * 81) for i in range(2000)]
    dealt = kd_shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    dealt_right(rows, dealt, 0.01 * 2000 * 202 / 8)


def test_one_long_conversation(spark):
    """A third of all turns, of which pairs differ late; turns repeat and turn numbers are null."""
    draw = random.Random(2)
    long = [(1, i if i % 50 else None, "assistant" if i % 2 else "user", f"turn {i % 30}") for i in range(6000)]
    rest = [(c, i, "user", "a b") for c in range(2, 2002) for i in range(draw.randrange(1, 10))]
    chosen = long + rest
    rejected = [(c, i, r, t + "!" if i == 5000 and c == 1 else t) for c, i, r, t in chosen]
    turns = "conv_id long, turn long, role string, text string"
    found = preference.preference_segments(spark.createDataFrame(chosen, turns), spark.createDataFrame(rejected, turns))
    assert rows_of(found, *OP7) == brute_preferences(chosen, rejected)


def test_a_document_that_holds_the_benchmark(spark):
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(15 + k % 3))) for k in range(60)] + [("dup", " ".join(f"w3x{j}" for j in range(15)))]
    whole = " and ".join(t for _, t in items)
    docs = [(1, whole), (2, whole + " more"), (2, whole + " more"), (3, items[5][1]), (4, "nothing"), (None, whole), (5, None)]
    d = spark.createDataFrame([(*r, "h") for r in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id string, text string")
    for most in (1, 7, 1000):
        assert rows_of(decontam.contamination(d, b, most_items=most), *OP10) == brute_contamination(docs, items)
    kept = decontam.contamination(d, b, most_items=7, keep=d.columns)
    assert kept.count() == len(docs) and kept.select("row.hits").distinct().count() == 1


def test_a_hub_of_links(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(50)]
    found = {r.node: r.root for r in simhash.components(written(spark.createDataFrame(edges, "a long, b long"))).collect()}
    assert all(found[i] == 0 for i in range(3000)) and all(found[10_000 + i] == 10_000 for i in range(51))


def test_sample_in_bytes(spark):
    """A text of more passages than fit isn't in the sample, the others are."""
    rows = [(i, "good words here " * 40 if i % 2 else "@@ ## $$ " * 40) for i in range(60)] + [(1000, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    net = quality_mil.train(docs, labels, most_bytes=60_000)
    without = quality_mil.train(docs.filter("doc_id < 1000"), labels, most_bytes=60_000)
    assert all(np.array_equal(net.p[k], without.p[k]) for k in net.p)
