import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import minhash as M
from tidewell.llm.components import connected_components
from tidewell.llm.rolling import word_hashes


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {words[0]} if words else set()


def brute(rows):
    ids = [d for d, _ in rows]
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in zip(ids, sets, strict=True)}


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(len(own))] = r.choice("red green blue black white".split())
        out.append(" ".join(own))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "   ", "one", "One", "ONE two", "one two", "a b c", "a\tb\nc"]
    for n, size, edits in ((60, 80, 12), (30, 200, 25), (5, 40, 3), (40, 120, 14)):
        texts += family(r, [r.choice(vocabulary) for _ in range(size)], n, edits)
    texts += [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("stars", [0, 1, 4])
def test_same_components_as_brute_force(spark, monkeypatch, stars):
    monkeypatch.setattr(M, "STAR_ROUNDS", stars)
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.link(docs).collect()}
    assert got == brute(rows)


def test_nothing_joined_passes_the_driver(spark, monkeypatch):
    """However small a side is, no plan broadcasts it: up to Spark's limit such sides grow with the corpus, and so does what the driver holds."""
    monkeypatch.setattr(M, "STAR_ROUNDS", 1)
    monkeypatch.setattr(M, "BLOCK", 16)
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    rows = corpus(7)
    kept = {r.doc_id for r in M.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList(before, store.executionsCount() - before)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert kept == {d for d, (_, c) in brute(rows).items() if d == c}
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "A b  c d"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in M.link(docs).collect())
    assert got == [(-1, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (4, 0, 4, True), (9, 3, 3, False)]
    assert M.link(docs.limit(0)).count() == 0
    assert {r.doc_id for r in M.keep_one(docs).collect()} == {None, 3, 4}


def test_components_of_a_path_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 130)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 130)}


def test_components_read_edges_about_once(spark, monkeypatch):
    """All rounds together leave few more edges than there are: labels that spread over whole edges in every round read each of them again."""
    from tidewell.llm import components

    written, settle = [], components.settle

    def counted(df, name="step"):
        out = settle(df, name)
        if name == "edges":
            written.append(out.count())
        return out

    monkeypatch.setattr(components, "settle", counted)
    r = random.Random(3)
    ids = list(range(600))
    path = r.sample(ids, len(ids))
    edges = [*zip(path, path[1:], strict=False), *((r.choice(path), r.choice(path)) for _ in range(2000)), (7, 7), (1000, 1000), (2001, 2000), (2000, 2001)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 2000: 2000, 2001: 2000}
    assert len(written) > 2 and written[-1] == 0 and sum(written[1:]) < written[0]
    written.clear()
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} and len(written) < 25


def test_words_built_to_collide_are_not_linked(spark):
    """A Thue-Morse word and its complement have the same polynomial modulo 2**64, whatever the odd base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{word} end"), (2, f"{other} end"), (3, f"{word} end"), (4, "x" * 300_000 + " end"), (5, "x" * 300_001 + " end")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in M.link(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_word_hashes():
    text = " ".join(["", "a", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "b" + "a" * 16, "a" * 600, "a" * 601, "a" * 9, "a\0", "a"])
    data = np.frombuffer(text.encode(), np.uint8)
    edges = [i for i, c in enumerate(text) if c == " "]
    h = word_hashes(data, np.array([e + 1 for e in edges]), np.array([*edges[1:], len(text)]))
    words = text.split(" ")[1:]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
