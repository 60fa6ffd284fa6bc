import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup as D

ROWS = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 100_000), (8, "X" * 100_000), (3, "É"), (None, "same text"), (None, "alone")]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("norm", F.lit("clash")).withColumn("keep_id", F.lit("clash"))


def lowered(text):
    return (text or "").encode().lower().decode()


def check(spark, **how):
    got = sorted((tuple(r) for r in D.mark_duplicates(frame(spark), **how).collect()), key=repr)
    groups: dict = {}
    for d, t in ROWS:
        groups.setdefault(lowered(t), []).append(d)
    want = []
    for d, t in ROWS:
        own = groups[lowered(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((d, keep, len(own), d == keep, how.get("digest", D.sha256)(lowered(t).encode()).hex()))
    assert got == sorted(want, key=repr)


def test_groups(spark):
    check(spark)
    assert D.mark_duplicates(frame(spark).limit(0)).count() == 0
    kept = D.drop_duplicates(frame(spark))
    assert kept.columns == ["doc_id", "text", "norm", "keep_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "6", "8", "9", "None"]


@pytest.mark.parametrize("salts", [1, 3])
def test_salts_don_t_matter(spark, salts):
    a = D.mark_duplicates(frame(spark).repartition(7), salts)
    assert a.exceptAll(D.mark_duplicates(frame(spark))).isEmpty()


def test_texts_decide_when_digests_clash(spark):
    """With a digest of one byte many texts share one: grouping is by digest and text."""

    def weak(data: bytes) -> bytes:
        return data[:1]

    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "ab")], "doc_id long, text string")
    groups = D.duplicate_groups(docs, digest=weak)
    assert {(r.digest, r.norm, r.keep_id, r.group_size) for r in groups.collect()} == {(b"a", "a", 2, 2), (b"b", "b", 3, 1), (b"a", "ab", 4, 1)}
    check(spark, digest=weak)
    assert sorted(str(r.doc_id) for r in D.drop_duplicates(frame(spark), digest=weak).collect()) == ["3", "4", "6", "8", "9", "None"]


def test_rows_go_and_not_ids(spark):
    """A copy doesn't survive beside another row of its id, and identical rows leave one."""
    docs = spark.createDataFrame([(3, "A"), (9, "a"), (3, "B"), (3, "B"), (None, "z"), (None, "Z"), (None, "y")], "doc_id long, text string").withColumn("__d", F.lit(1))
    kept = D.drop_duplicates(docs.repartition(5))
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("3", "b"), ("9", "a"), ("None", "y"), ("None", "z")]
    assert kept.columns == docs.columns and D.drop_duplicates(docs.limit(0)).count() == 0
