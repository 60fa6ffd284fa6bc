import random
import re

import numpy as np

from pyspark.sql import functions as F

from tidewell.llm import sentence_spans as S


def cut_up(text):
    """Sentences as lists of (word, where it begins), from the definition."""
    out, words = [], list(re.finditer(r"[^ \t\n\v\f\r]+", text))
    for k, w in enumerate(words):
        if k == 0 or words[k - 1].group()[-1] in ".!?" or "\n" in text[words[k - 1].end() : w.start()]:
            out.append([])
        out[-1].append((w.group(), w.start()))
    return out


def brute(rows):
    seen, gone = {}, {}
    texts = {(d, t or "") for d, t in rows}
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, t in order:
        own = cut_up(t)
        for p in range(len(own) - S.SPAN + 1):
            run = tuple(w for x in own[p : p + S.SPAN] for w, _ in x)
            if len(run) >= S.WORDS and seen.setdefault(run, (d, t, p)) != (d, t, p):
                gone.setdefault((d, t), set()).update(range(p, p + S.SPAN))
    out = []
    for d, t in rows:
        own, g = cut_up(t or ""), gone.get((d, t or ""), set())
        starts = [x[0][1] for x in own] + [len(t or "")]
        out.append((d, len(own), len(g), (t or "")[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(own)) if k not in g)))
    return out


def prose(r, n):
    return " ".join(" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randint(1, 30))) + r.choice([". ", ".\n", "! ", ", ", "\n"]) for _ in range(n))


def test_same_as_brute_force(spark):
    r = random.Random(4)
    shared = [prose(r, 6) for _ in range(3)]
    texts = [prose(r, r.randint(0, 6)) + r.choice(shared) + prose(r, r.randint(0, 6)) for _ in range(40)]
    rows = [*enumerate(texts), (41, None), (42, ""), (43, "..."), (44, texts[0]), (44, texts[0]), (45, "x. " * 30), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("extra")).coalesce(1)
    got = [tuple(x) for x in S.remove_repeats(docs, passages=False).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert any(x[2] for x in got)
    assert sorted(map(tuple, S.remove_repeats(docs.repartition(5), passages=False).collect()), key=repr) == sorted(got, key=repr)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_sentence_starts():
    r = random.Random(9)
    for text in [*("".join(r.choice("ab .,!?\n;:") for _ in range(r.randint(0, 80))) for _ in range(300)), "One 3.5 two. Three! Four\nfive", "a" * 100_000 + "." * 100_000]:
        data = np.frombuffer(text.encode(), np.uint8)
        start, stop = S.words_of(data)
        sizes = np.diff(S.sentence_starts(data, start, stop)).tolist()
        assert sizes == [len(x) for x in cut_up(text)]


def test_cuts_depend_on_the_words_around():
    r = np.random.default_rng(3)
    middle = r.integers(0, 1 << 60, 200, dtype=np.uint64)
    placed = []
    for n in (0, 7, 90):
        before = r.integers(0, 1 << 60, n, dtype=np.uint64)
        at = S.cuts(np.concatenate((before, middle, before)))
        placed.append({int(x) - n for x in at if n + S.WINDOW <= x <= n + 200 - S.WINDOW})
        assert np.diff(at).max() <= S.WINDOW
    assert placed[0] == placed[1] == placed[2]


def test_long_passages_go_wherever_they_lie(spark):
    """Passages of 51 to 80 words in two comma-less sentences, the edges of other sentences, against a word-window brute force."""
    r = random.Random(7)

    def words(n):
        return ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(n)]

    rows, planted = [], []
    for k in range(30):
        passage = words(r.randint(51, 80))
        passage[r.randint(20, 30)] += "."
        for copy in range(2):
            rows.append((2 * k + copy, " ".join([*words(r.randint(0, 40)), *passage, *words(r.randint(0, 40))]) + "."))
        planted.append(passage)
    rows.append((100, " ".join(words(400))))
    seen, repeated = {}, {}
    for d, t in rows:
        own = t.split()
        for i in range(len(own) - 50):
            if seen.setdefault(tuple(own[i : i + 51]), d) != d:
                repeated.setdefault(d, set()).update(range(i, i + 51))
    got = {x.doc_id: x for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(repeated) == {2 * k + 1 for k in range(30)}
    for d, t in rows:
        own, left = t.split(), set(got[d].text.split())
        gone = {i for i, w in enumerate(own) if w not in left}
        wanted = repeated.get(d, set())
        assert gone <= wanted, d
        assert (got[d].n_removed > 0) == bool(wanted)
        if wanted:
            assert min(gone) - min(wanted) < S.WINDOW and max(wanted) - max(gone) <= S.WINDOW and gone == set(range(min(gone), max(gone) + 1)), d
