import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import suffix_repeats as S


def brute(texts):
    data = [("" if t is None else t).encode() for t in texts]
    times = Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - S.LENGTH + 1):
            if times[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "été", "naïve", "x", "lorem", "ipsum", "dolor", "sit", "amet"] + [str(i) for i in range(200)]

    def prose(k):
        return " ".join(r.choice(words) for _ in range(k))

    shared = [prose(k) for k in (45, 60, 120, 300)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 700, "ab" * 400, prose(30)]
    for _ in range(n):
        parts = [prose(r.randint(0, 150)) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared)[r.randint(0, 30) :])
        texts.append(" ".join(parts))
    for t in r.sample(texts[8:], 8):
        at = r.randint(0, len(t))
        texts += [t, t[:at] + "#" + t[at:], t[:at] + t[at + 3 :]]
    line = prose(20) + "\n"
    return [*texts, line * 9, prose(40) + shared[1] + prose(3) + shared[1]]


def told(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.digest(S.remove_repeats(docs)).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_same_as_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert told(spark, texts) == brute(texts)


def test_one_passage_in_many_texts(spark):
    """A hot anchor: a passage between words that differ everywhere, and one very long text that holds it too."""
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(90))
    texts = [f"{r.random()} {passage}{' ' * r.randint(0, 3)}{r.random()}" for _ in range(2000)]
    texts.append("".join(f"{r.random()} " for _ in range(10_000)) + passage)
    assert told(spark, texts) == brute(texts)


def test_groups_hold_all_occurrences(spark):
    texts = corpus(5, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [("" if t is None else t).encode() for t in texts]
    groups: dict = {}
    rows = S.repeat_groups(docs).collect()
    for r in rows:
        groups.setdefault((r["repeat"], r.length), set()).add(data[r.doc_id][r.start : r.start + r.length])
    assert groups and all(len(strings) == 1 for strings in groups.values())
    covered = [np.zeros(len(d), bool) for d in data]
    for r in rows:
        covered[r.doc_id][r.start : r.start + r.length] = True
    assert [int(c.sum()) for c in covered] == [x[1] for x in brute(texts)]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.digest(S.remove_repeats(empty)).count() == 0
    twice = spark.createDataFrame([(1, "z" * 50 + "abcdefg " * 40), (1, "z" * 50 + "abcdefg " * 40), (None, None)], "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("row_id", F.lit("x"))
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats(twice).collect()}
    assert got == {(1, 370, 370), (None, 0, 0)}


def test_pieces_hold_every_window_once():
    for text in corpus(6, 20):
        data = (text or "").encode()
        first, n, lead, _ = S.pieces(np.frombuffer(data, np.uint8))
        assert sorted(w for a, k in zip(first.tolist(), n.tolist(), strict=True) for w in range(a, a + k)) == list(range(max(len(data) - S.LENGTH + 1, 0)))
        assert ((lead - n + 1 >= 0) & (lead <= S.REACH)).all()


def test_interval_tree():
    text = b"banana$banana!"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    tree, found = S.IntervalTree(1), []
    for k, i in enumerate(order):
        found += tree.add(i, text[i - 1] if i else -1, S.common_bytes(text[order[k - 1] :], text[i:]) if k else 0)
    found = {(n, tuple(sorted(members))) for n, members in found + tree.end()}
    assert (6, (0, 7)) in found and (3, (1, 3, 8, 10)) in found and (1, (1, 3, 5, 8, 10, 12)) in found
    assert not any(n == 2 for n, _ in found)
