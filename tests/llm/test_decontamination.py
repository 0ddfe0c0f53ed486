"""Benchmark items with other numbers, names and units, against a plain version; odd rows and columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontamination

FOLDER = "/root/testdata/sf0.001"
ITEM = "On Monday the farmer Alice sold 12 kg of red apples to her neighbour Bob for 30 dollars at the old market near the small town"


def found(spark, items, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench, **more).collect()}


@pytest.mark.parametrize("old, new", [("Alice", "Mary Ann"), ("Bob", "Juan Carlos Pérez"), ("12", "1,250.75"), ("30", "3.5"), ("12", "7"), ("kg", "pounds"), ("Alice", "Жанна")])
def test_slots_of_several_words(spark, old, new):
    for a, b in ((ITEM, ITEM.replace(old, new)), (ITEM.replace(old, new), ITEM)):
        got = found(spark, [a], ["x. " + b + ". y"])
        assert got[0, 0].coverage == 1 and not got[0, 0].same_wording


def test_contradicting_alignments(spark):
    """Halves of an item with names that don't fit together don't count together; two whole copies with other names each do no harm."""
    item = "the farmer Alice went along the road to the market and then sold all of it . the farmer Alice came back along the river at night with money"
    half = item.index(" . ")
    a, b = item[:half].replace("Alice", "Maria"), item[half:].replace("Alice", "Paula")
    filler = " and so on and so forth it went for quite some time " * 3
    got = found(spark, [item], [a + filler + b, a + filler + b.replace("Paula", "Maria"), item.replace("Alice", "Maria") + filler + item.replace("Alice", "Paula")])
    assert got[0, 0].coverage < got[1, 0].coverage and got[2, 0].coverage == 1


def changed(text, rnd):
    """Every number another one, every name within a sentence another name, the same ones for the same ones."""
    to = {}
    text = re.sub(r"\d+", lambda m: to.setdefault(m.group(), str(rnd.randint(2, 9999))), text)
    return re.sub(r"(?<=[a-z,] )[A-Z][a-z]+", lambda m: to.setdefault(m.group(), rnd.choice(["Xavier", "Yolanda", "Zeno", "Quentin", "Ulrike"]) + "abcdefghij"[len(to) % 10]), text)


def test_benchmark_of_the_tables(spark):
    """Copies of all items, as they are and changed, within documents: all are found; documents without any aren't."""
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect()]
    rnd = random.Random(4)
    plain = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect() if r.text and not any(i in r.text for i in items)][:40]
    texts = [f"{plain[i % len(plain)]}\n{x}\n" for i, x in enumerate(items)] + [f"{plain[i % len(plain)]}\n{changed(x, rnd)}\n" for i, x in enumerate(items)]
    got = found(spark, items, texts + plain)
    n = len(items)
    assert all((i, i) in got and got[i, i].coverage == 1 for i in range(n))
    assert sum((n + i, i) in got for i in range(n)) >= 0.95 * n
    assert all(d < 2 * n for d, _ in got)


def test_odd_rows(spark):
    rows = [(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, ""), (4, "word " * 50_000 + ITEM), (5, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("row", "hash", "form", "item_id", "size")))
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (7, "a b c d e f g"), (8, ITEM), (None, ITEM), (9, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()]
    assert sorted(got) == [(1, 7), (1, 7), (1, 8), (1, 8), (4, 7), (4, 8)]
    left = decontamination.without(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(2, None), (3, ""), (5, "clean")], key=lambda x: x[0])
    assert decontamination.without(docs, bench.limit(0)).count() == len(rows)
