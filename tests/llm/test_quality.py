import random
from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm import quality as Q


def brute(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    gone = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(gone)


def test_stats_same_as_brute_force():
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice(["a ", "b ", "é ", "#", "\n", "\t", "a b c ", "\u00a0", "\x1c"]) for _ in range(r.randint(0, 60)))
        assert Q.text_stats(text) == brute(text)
    assert Q.text_stats("") == (0, 0, 0, 0, 0, 0)


def test_fences_follow_languages_and_sources(spark):
    r = random.Random(2)

    def prose(n, size):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(size)) for _ in range(n))

    rows = [(i, prose(100, 5), "en", "web") for i in range(300)] + [(1000 + i, prose(100, 12), "de", "web") for i in range(300)]
    rows += [(5000, prose(100, 12), "en", "web"), (5001, " ".join(x + "###" for x in prose(100, 5).split()), "en", "new"), (5002, prose(20, 5), "en", "web"), (5003, None, None, None), (5004, prose(100, 5), "en", "new"), (5004, prose(100, 5), "en", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1)).withColumn("total", F.lit(1))
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300))
    assert not got[5000].kept and not got[5000].base_failed, "long words are usual in one language only"
    assert not got[5001].kept and got[5004].kept
    assert got[5002].base_failed and got[5003].base_failed and not got[5003].kept
    assert Q.judge(docs).count() == len(rows) and Q.judge(docs.limit(0)).count() == 0


def test_very_long_words_meet_a_fence_however_high(spark):
    """Words of 300 letters are usual in one language; words of 3,000 are not."""
    rows = [(i, " ".join("w" * (300 + (i * k) % 7) + str(k) for k in range(60)), "xx", "s") for i in range(120)]
    rows += [(900, " ".join("w" * 3000 + str(k) for k in range(60)), "xx", "s"), (901, "x" * 1_000_000, "xx", "s"), (902, "", None, "s")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(120)) and not got[900].kept and not got[900].base_failed
    assert got[901].base_failed and got[901].word_chars == 1_000_000 and not got[902].kept


def test_sketches_merge_and_answer_quartiles(spark):
    r = random.Random(6)
    values = [r.choice([r.randint(0, 900), r.randint(1000, 50_000)]) for _ in range(999)]
    stats = spark.createDataFrame([(v * 50, 500, 0, 1, 0, 0, "l", f"s{k % 3}", False) for k, v in enumerate(values)], "word_chars long, n_words long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, lang string, source string, base_failed boolean")
    found = {(x.lang, x.source): x for x in Q.quartiles(Q.sketches(stats)).filter("metric = 'length'").collect()}
    for key, own in [((None, None), values), (("l", None), values), (("l", "s1"), values[1::3])]:
        x, own = found[key], sorted(own)
        for q, rank in ((x.q1, -(-len(own) // 4)), (x.q3, -(-3 * len(own) // 4))):
            assert 0 <= own[rank - 1] - q <= own[rank - 1] / 512 and x.total == len(own)
