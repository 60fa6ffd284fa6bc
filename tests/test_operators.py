import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.operators import kv, merge, rank, records, search, series, setops, spatial
from tidewell.sources import snapshots
from tidewell.sources.tables import shared_dir

ROW = "key long, value double, vsn int, time long"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(k, float(k * k), 2, k * 10) for k in range(1, 21)], ROW)


def keys(df):
    return [r.key for r in df.collect()]


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [(("open", 3), ("open", 6), [4, 5]), (("closed", 3), ("closed", 6), [3, 4, 5, 6]), (("open", 6), ("closed", 3), [5, 4, 3]), (("closed", 5), ("closed", 5), [5]), (("open", 5), ("closed", 5), []), (("closed", 30), ("open", 25), [])],
)
def test_ranges(small, start, end, want):
    assert keys(kv.scan_between(small, *start, *end)) == want


def test_half_ranges_and_pages(small):
    assert keys(kv.scan(small, "descending", "open", 3)) == [2, 1]
    assert keys(kv.scan(small, "ascending", "closed", 19)) == [19, 20]
    seen, after = [], None
    while page := keys(kv.page(small, after, 7)):
        seen += page
        after = page[-1]
    assert seen == list(range(1, 21))
    assert kv.limited(small, 20, F.col("key")).first().more is False and kv.limited(small, 19, F.col("key")).first().more is True


def test_stateful_filters(small):
    assert keys(kv.take_while(small, F.col("value") < 50).orderBy("key")) == list(range(1, 8))
    assert keys(kv.take_while(small, F.col("value") < 50, inclusive=True).orderBy("key")) == list(range(1, 9))
    assert kv.take_while(small, F.col("value") < 5000).count() == 20
    assert keys(kv.running_filter(small, F.col("key"), 15).orderBy("key")) == [1, 2, 3, 4, 5]


def test_reads(spark, small):
    got = {r.key: (r.value, r.vsn, r.time) for r in kv.read(small, spark.createDataFrame([(3,), (99,)], "key long"), default=-1.0).collect()}
    assert got == {3: (9.0, 2, 30), 99: (-1.0, 0, 0)}
    nulled = spark.createDataFrame([(1, None, 2, 0)], ROW)
    assert kv.read(nulled, spark.createDataFrame([(1,)], "key long"), default=5.0).first().value is None


def test_versions(spark, small):
    changes = spark.createDataFrame([(1, -1.0, 0, 5), (2, -2.0, 2, 5), (3, -3.0, 9, 5), (50, -5.0, 1, 5), (4, -4.0, 1, 5), (60, 0.0, 3, 5)], ROW)
    got = {r.key: (r.value, r.vsn) for r in merge.write(small, changes).collect()}
    assert (got[1], got[2], got[3], got[4], got[50]) == ((-1.0, 3), (-2.0, 3), (9.0, 2), (16.0, 2), (-5.0, 2)) and 60 not in got
    assert {(r.key, r.asked, r.actual) for r in merge.conflicts(small, changes).collect()} == {(3, 9, 2), (4, 1, 2), (60, 3, 0)}
    assert merge.write(small.limit(0), changes.filter("vsn = 0")).first().vsn == 2
    refused = merge.transaction({"t": small}, lambda t: {"t": changes})
    assert refused["t"].exceptAll(small).isEmpty()


def test_snapshots(spark, small):
    root = f"{shared_dir(spark)}/t-{random.random()}"
    snapshots.snapshot(small, root)
    snapshots.increment(spark.createDataFrame([(1, 100.0, 3, 900), (2, 0.0, 0, 901), (30, 3.0, 2, 5)], ROW), root)
    now = {r.key: r.value for r in snapshots.load(spark, root).collect()}
    assert now[1] == 100.0 and 2 not in now and now[30] == 3.0 and len(now) == 20
    assert snapshots.load(spark, root, as_of=0).count() == 20 and 2 in keys(snapshots.load(spark, root, as_of=0))
    snapshots.compact(spark, root)
    snapshots.increment(spark.createDataFrame([(2, 7.0, 4, 950)], ROW), root)
    assert snapshots.load(spark, root).count() == 21


def test_ranks(spark, small):
    got = {r.key: r.rank for r in rank.with_rank(small, ["key"]).collect()}
    assert got == {k: k for k in range(1, 21)}
    want = spark.createDataFrame([(0,), (5,), (100,)], "key long")
    assert {(r.key, r["rank"], r.found) for r in rank.ranks_of(small.select("key"), "key", want).collect()} == {(0, 1, False), (5, 5, True), (100, 21, False)}
    assert rank.by_rank(small, "key", 7).first().key == 7
    assert tuple(rank.neighbours(small, "key", 1).first()) == (None, 2)


def test_replicas(spark, small):
    other = small.filter("key > 2").withColumn("value", F.when(F.col("key") == 9, 0.0).otherwise(F.col("value")))
    assert {(r.key, r.state) for r in setops.replica_diff(small, other).collect()} == {(1, "missing_right"), (2, "missing_right"), (9, "unequal")}
    assert setops.digest(small).first() == setops.digest(small.orderBy(F.col("key").desc())).first()
    assert setops.unequal_buckets(small, small, 8).isEmpty()
    assert setops.repair(small, other.withColumn("vsn", F.lit(3)), 8).filter("vsn = 3").count() == 18


def test_records(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "c", None)], "id long, name string, size int")
    assert {r.id for r in records.select(rows, [("name", "!=", "a")]).collect()} == {3}
    assert {r.id for r in records.select(rows, [("size", "lacks")]).collect()} == {3}
    changed = records.update(rows, [("id", ">", 1)], {"size": ("+", 1), "name": ("set", "z")})
    got = {r.id: (r.name, r.size, [(x.key, x.kind) for x in r["diff"]]) for r in changed.collect()}
    assert got == {1: ("a", 5, []), 2: ("z", 8, [("size", "modify"), ("name", "insert")]), 3: ("z", None, [("name", "modify")])}
    stays, goes = records.delete(rows, [("size", ">", 5)])
    assert stays.count() == 2 and goes.first().id == 2


def test_search(spark):
    docs = spark.createDataFrame([(1, "error in disk"), (2, "disk error error"), (3, None), (4, "erring 10%_\\")], "doc_id long, text string")
    posts = search.tokens(docs)
    assert {r.doc_id for r in search.boolean_search(posts, ("and", "error", ("or", "in", "disk"))).collect()} == {1, 2}
    index = search.gram_index(posts)
    for pattern, want in (("err$", {"error", "erring"}), ("$r", {"error"}), ("$is$", {"disk"}), ("in", {"in"}), ("$", {"error", "in", "disk", "erring", "10%_\\"}), ("$%_$", {"10%_\\"})):
        assert {r.token for r in search.matching_tokens(index, pattern).collect()} == want, pattern


def test_series(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0), ("a", 20.0, 0.0)], "s string, t double, v double")
    at = spark.createDataFrame([("a", 5.0), ("a", 15.0), ("a", 25.0), ("b", 1.0)], "s string, t double")
    assert {(r.s, r.t, r.v) for r in series.interpolate(points, at, "s", "t", "v").collect()} == {("a", 5.0, 10.0), ("a", 15.0, 10.0), ("a", 25.0, None), ("b", 1.0, None)}
    paths = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 0, 1.0), (7, 8, 1.0)], "a long, b long, cost double")
    assert {(r.node, r.cost) for r in spatial.shortest_paths(paths, 0).collect()} == {(0, 0.0), (2, 1.0), (1, 2.0)}


def test_scalars(spark):
    df = spark.createDataFrame([(b"\0\0hello",), (b"",), (None,)], "b binary")
    for make, back in ((S.base58_encode, S.base58_decode), (S.deflate, S.inflate), (S.gzipped, S.gunzipped)):
        rows = df.select("b", back(make("b")).alias("c")).collect()
        assert all(r.b == r.c for r in rows)
    assert spark.range(30).filter(S.is_prime(F.col("id"))).count() == 10


def test_compression_holds_few_texts(spark):
    far = F.col("id") >= 3000
    texts = spark.range(0, 6000, 1, 1).select(F.when(far, F.raise_error(F.lit("too far ahead")).cast("string")).otherwise(F.repeat(F.lit("a text of "), 1000)).cast("binary").alias("b"))
    for make, back in ((S.deflate, S.inflate), (S.gzipped, S.gunzipped)):
        assert texts.select(back(make("b")).alias("c")).filter(F.length("c") > 0).first().c == b"a text of " * 1000  # the filter keeps the limit above


def test_overlaps_with_rests(spark):
    def shown(a, z, b, y):
        got = spark.range(1).select(setops.overlap_rests(*[F.lit(x) for x in (a, z, b, y)]).alias("o")).first().o
        return tuple(x and tuple(x) for x in got)

    assert shown(1, 4, 1, 4) == (None, (1, 4, True, True), None)
    assert shown(1, 2, 4, 5) == ((1, 2, True, True), None, (4, 5, True, True))
    assert shown(1, 3, 3, 5) == ((1, 3, True, False), (3, 3, True, True), (3, 5, False, True))
    assert shown(2, 9, 3, 5) == ((2, 3, True, False), (3, 5, True, True), (5, 9, False, True))


def test_clear_digests_and_choice(spark):
    t = spark.createDataFrame([(k, float(k), 2, 0) for k in range(9)], "key long, value double, vsn int, time long")
    rest, before = kv.cleared(t)
    assert (rest.count(), before.first().n) == (0, 9)
    assert setops.digest_diff(t, t).first().unequal == []
    assert setops.digest_diff(t, t.limit(0)).first().unequal == ["first", "last", "size", "hash"]
    places = [setops.shuffled(t.repartition(n), "key", 5).orderBy("key").select("place").collect() for n in (1, 4)]
    assert places[0] == places[1] and sorted(r.place for r in places[0]) == list(range(1, 10))
    loads = spark.createDataFrame([("a", 0), ("b", 3), ("c", 2), ("d", 9)], "node string, n long")
    assert {r.node for r in rank.least_loaded(loads, "n", 2, 2).collect()} == {"a", "b", "c"}
    assert rank.least_loaded(loads.limit(0), "n", 2, 2).count() == 0


def test_folds_and_fields(spark):
    row = spark.range(1).select(
        S.fold_until(F.array(F.lit(2), F.lit(3), F.lit(5)), F.lit(0), lambda a, x: a + x, lambda a: a > 4).alias("some"),
        S.fold_until(F.array().cast("array<int>"), F.lit(1), lambda a, x: a + x, lambda a: a > 4).alias("none"),
        S.get_column(F.array(F.lit(7), F.lit(8)), 0).alias("own"),
        S.set_column(F.array(F.lit(7), F.lit(8)), 2, F.lit(1)).alias("set"),
    ).first()
    assert tuple(row) == (5, 1, [7, 8], [7, 1])


def test_byte_range_parses_a_header_once(spark):
    headers = {"bytes=0-4": (0, 4), "bytes=-5": (5, 9), "bytes=3-": (3, 9), "bytes=0-99": (0, 9), "bytes=9-2": None, "bytes=50-60": None, "bytes=-0": None, "bytes=007-0009": (7, 9), "bytes=1-9999999999999999999": (1, 9)}
    found = spark.createDataFrame([(h, 10) for h in headers], "h string, size long").select("h", S.byte_range(F.col("h"), F.col("size")).alias("r"))
    assert {r.h: tuple(r.r) if r.r else None for r in found.collect()} == headers
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_posting_chunks_shuffle_once(spark):
    docs = spark.createDataFrame([(1, "b a\ta "), (1, "b"), (250, "a"), (3, None), (4, ""), (99, " a")], "doc_id long, text string")
    chunks = search.posting_chunks(search.words(docs), 100)
    assert sorted(tuple(r) for r in chunks.collect()) == [("a", 0, [1, 99]), ("a", 2, [250]), ("b", 0, [1])]
    assert sorted(tuple(r) for r in search.posting_chunks(search.tokens(docs), 100).collect()) == [("a", 0, [1, 99]), ("a", 2, [250]), ("b", 0, [1])]
    planned = search.posting_chunks(search.words(docs), 100)._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") == 1
