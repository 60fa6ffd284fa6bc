import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidewell.llm import packing as K

PATH = P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, WORLD! it's 12 o'clock", "naïve café ÉTÉ", "Σίσυφος ΟΔΟΣ İstanbul", "a\x1cb\x0bc d", "<|endoftext|> x <|ENDOFTEXT|>", "!'s ''s 's", "é café", "日本語 text", "x" * 300,
    "tab\tnew\nline\r\n", "don't we'll I'm they've you'd ½ ²", "“quotes” – dash… €5",
]


def test_ids_equal_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    r = random.Random(5)
    alphabet = "abcdefgh   '\"!?.,sStTrReEvVmMlLdD\n\tÉéßñ123½-_<|>"
    plain = [x or "" for x in TEXTS] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(300)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(plain, add_special_tokens=False)]
    assert K.WordEncoder(PATH)(plain) == want


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(30):
        cap = r.choice([10, 16, 50])
        lengths = [r.randint(1, cap) for _ in range(r.randint(1, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = K.plan(counts, cap)
        filled: dict[int, int] = {}
        placed = dict.fromkeys(counts, 0)
        for length, lo, hi, seq, each, offset in rows:
            assert lo == placed[length]
            placed[length] = hi
            for k in range(hi - lo):
                s = seq + k // each
                assert filled.get(s, 0) == offset + k % each * length
                filled[s] = filled.get(s, 0) + length
        assert placed == counts and max(filled.values()) <= cap
        gaps: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(cap - n)
            else:
                gaps[gaps.index(fit)] = fit - n
        assert len(filled) == len(gaps)


def test_pack_rows(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (50, "word " * 9000), (50, "word " * 9000), (None, "no id")], "doc_id long, text string").selectExpr("*", "1 AS local", "'x' AS offset")
    pieces = K.tokenise(docs, PATH, with_ids=True)
    packed = K.pack(pieces)
    rows = packed.collect()
    t = Tokenizer.from_file(PATH)
    long = [*t.encode("word " * 9000, add_special_tokens=False).ids, 1]
    own = sorted((r for r in rows if r.doc_id == 50), key=lambda r: (r.piece, r.sequence_id))
    assert [r.length for r in own] == [4096, 4096, 4096, 4096, 809, 809]
    assert own[4].ids_crc32 == zlib.crc32(np.array(long[8192:], "<u4").tobytes()) and own[4].start == 8192
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by) == -(-total // 4096)
    made = {r.sequence_id: r for r in K.sequences(packed).collect()}
    for s, members in by.items():
        for r in members:
            assert made[s].ids[r.offset : r.offset + r.length] == r.ids
    assert K.pack(K.tokenise(docs.limit(0), PATH)).count() == 0


def test_rounds_need_no_more_sequences_than_best_fit(spark):
    r = random.Random(8)
    for lengths in ([min(4096, int(r.lognormvariate(6, 1.3)) + 1) for _ in range(6000)], [r.randint(1000, 1400) for _ in range(3000)], [4096] * 50, [7]):
        pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long").repartition(6)
        rows = K.pack(pieces).collect()
        assert sorted((x.doc_id, x.length) for x in rows) == list(enumerate(lengths))
        best = K.plan({n: lengths.count(n) for n in set(lengths)}, 4096)
        fewest = max(seq + -(-(hi - lo) // each) for _, lo, hi, seq, each, _ in best)
        assert len({x.sequence_id for x in rows}) <= fewest * 1.001 + 1
