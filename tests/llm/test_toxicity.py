import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")


def test_held_out_accuracy(tables):
    docs, known, held = tables
    model = T.train(docs, known)
    found = T.score(docs, model).withColumnRenamed("toxic", "told").join(held, "doc_id")
    n = {(r.told, r.toxic): r["count"] for r in found.groupBy("told", "toxic").count().collect()}
    caught, missed, wrong, clean = n.get((True, 1), 0), n.get((False, 1), 0), n.get((True, 0), 0), n[(False, 0)]
    assert caught / (caught + missed) > 0.8 and wrong / (wrong + clean) < 0.01, n


def test_thresholds_are_ordered_and_edges_are_defined(spark):
    words = "lovely dreadful awful fine day of the night and more".split()
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, " ".join([*rng.choice(words[3:], 12), *(["dreadful"] * (1 + i % 3) if bad else [])]), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "x " * 200_000), (None, "dreadful")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert model.thresholds[0] <= model.thresholds[1]
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(got) == 304 and all(r.p_mild >= r.p_severe and 0 <= r.severity <= 2 for r in got.values())
    assert all(got[i].toxic == bool(y) for i, _, y in rows) and got[None].toxic and not got[900].toxic
    kept = T.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 304 - 76
    untold = T.train(docs, labels.filter("toxic = 0"))
    assert T.score(docs, untold).filter("toxic OR severity > 0").isEmpty()
    assert T.score(docs.limit(0), model).count() == 0


def test_the_driver_holds_each_word_once(spark, monkeypatch):
    """A word of many samples is one string in the driver, not one per sample."""
    held = []
    monkeypatch.setattr(T, "fit", lambda samples: held.extend(samples))
    rows = [(i, f"common words shared by every text own{'abcdefgh'[i % 8]}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    T.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    strings: dict[str, set[int]] = {}
    for counts, _ in held:
        for word in counts:
            strings.setdefault(word, set()).add(id(word))
    assert len(held) == 40 and len(strings) == 14
    assert all(len(same) == 1 for same in strings.values())
