"""Queries that once read part of their rows, on rows beyond the old limits."""

import heapq
from datetime import datetime

import pytest

import __spark_entry__
from tidewell.operators import rank


@pytest.fixture
def run(spark, tmp_path):
    def run(name, **tables):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        return [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]

    return run


def test_primes_of_all_keys(run):
    keys = [*range(-2, 60), 2999, 3001, 3481, 9973, 10007, 150_001, 387 * 389]
    got = run("math_prime", orders=([(k,) for k in keys], "o_orderkey long"))
    assert sorted(got) == [(k,) for k in keys if k >= 2 and all(k % x for x in range(2, k))]


def test_list_edit_of_all_sizes(run):
    assert sorted(run("list_edit", part=([(1, 1), (2, 2), (3, 7)], "p_partkey long, p_size int"))) == [(1, "9,2"), (2, "9,2,2"), (3, "9,7,2")]


def test_trigrams_of_long_tokens(run):
    long = "".join(chr(0x4E00 + i) for i in range(5000))
    tokens = ["a", "ab", "b" * 198, "c" * 199, "d" * 200 + "e", long]
    got = run("log_trigrams", documents=([(1, " ".join(tokens))], "doc_id long, text string"))
    assert sorted(got) == sorted({(f"${t}$"[i : i + 3], t) for t in tokens for i in range(len(t))})


def test_interpolation_and_differences_of_all_events(run):
    rows = [(i, 7 if i % 4 else 1, datetime(2024, 1, 1 + i), float(i * i % 11)) for i in range(28)] + [(90, 2, datetime(2024, 1, 2), 4.0)]
    got = run("interpolate_linear", events=(rows, "event_id long, user_id long, ts timestamp, value double"))
    later, curve, cubic, sums = 0.6180339887, [], [], {}
    for user in (1, 2, 7):
        own = [(float(e), v, ts) for e, u, ts, v in rows if u == user]
        for k, (t, v, _) in enumerate(own):
            last = k == len(own) - 1
            x = None if last else later / (own[k + 1][0] - t)
            curve.append((user, t + later, None if last else v + (own[k + 1][1] - v) * x))
            if not last:
                b, w, a = own[max(k - 1, 0)][1], own[k + 1][1], own[min(k + 2, len(own) - 1)][1]
                y = (2 * x**3 - 3 * x**2 + 1) * v + (x**3 - 2 * x**2 + x) * (w - b) / 2 + (3 * x**2 - 2 * x**3) * w + (x**3 - x**2) * (a - v) / 2
            cubic.append((user, t + later, None if last else y))
        early, late = ([v for _, v, ts in own if (ts <= datetime(2024, 1, 15, 12)) == e] for e in (True, False))
        sums[user] = sum(late) - sum(early) if early and late else sum(early or late)
    for some, want in ((got, curve), (run("interpolate_catmull_rom"), cubic)):
        for g, w in zip(sorted(some), sorted(want), strict=True):
            assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 1e-4)
    assert dict(run("sample_difference")) == sums


def test_paths_to_all_nodes(run):
    got = run("spatial_paths", nation=([(k,) for k in range(25)], "n_nationkey int"))
    best, heap = {}, [(0.0, 0)]
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for k in (1, 2, 3) if node < 25 else ():
                heapq.heappush(heap, (cost + k * k + node % 3, node + k))
    assert len(best) == 28 and sorted(got) == sorted(best.items())


def test_no_row_at_a_position_beyond_the_last(spark):
    rows = spark.createDataFrame([(k,) for k in range(20, 0, -1)], "key long")
    assert [[r.key for r in rank.by_rank(rows, "key", n).collect()] for n in (1, 20, 21, 50, 200_000)] == [[1], [20], [], [], []]
