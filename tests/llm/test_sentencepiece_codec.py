import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewell.llm import sentencepiece_codec as S

MODEL = P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "Hello world", "naïve café", "▁ literal ▁▁ marks", "日本語 テキスト", "emoji 🤖🦀 ‍", "tab\tline\nend\r\n", "x" * 700, "á", "def f(x):\n    return x  # ok", "\x00\x01 bytes"]


@pytest.fixture(scope="module")
def codec():
    return S.PieceCodec(MODEL)


def brute(text, vocabulary, byte_ids, low, longest):
    if not text:
        return []
    own = [S.SPACE if c == " " else None if c == S.SPACE else c for c in " " + text]
    best = [(0.0, [])] + [None] * len(own)
    for stop in range(1, len(own) + 1):
        for size in range(1, min(longest, stop) + 1):
            part = own[stop - size : stop]
            if size > 1 and (None in part or any(a not in (None, S.SPACE) and b == S.SPACE for a, b in zip(part, part[1:], strict=False))):
                continue
            key = "".join(part) if None not in part else None
            if key in vocabulary:
                score, ids = vocabulary[key][0], [vocabulary[key][1]]
            elif size == 1:
                score, ids = low, [byte_ids[b] for b in (" " + text)[stop - 1].encode()]
            else:
                continue
            total = best[stop - size][0] + score
            if best[stop] is None or total > best[stop][0]:
                best[stop] = (total, best[stop - size][1] + ids)
    return best[-1][1]


def test_same_as_plain_viterbi(codec):
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = {p.id_to_piece(i): (p.get_score(i), i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("theingron  aeißé.,'▁") for _ in range(r.randint(1, 60))) for _ in range(150)]
    got = [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)]
    for t, ids in zip(texts, got, strict=True):
        assert ids == brute(t, vocabulary, codec.byte_ids.tolist(), codec.low, codec.longest), t


def test_round_trip(codec):
    r = random.Random(3)
    texts = TEXTS + ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0x2500, 0x2600), r.randint(0x1F300, 0x1F600)])) for _ in range(r.randint(1, 200))) for _ in range(200)]
    assert codec.decode([np.frombuffer(x, "<i4") for x in codec.encode(texts)]) == texts


def test_operators(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, TEXTS[3]), (None, None)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("lang", F.lit("en"))
    coded = S.encode(docs, MODEL)
    assert coded.columns == ["doc_id", "lang", "ids"]
    back = {(r.doc_id, r.text) for r in S.decode(coded, MODEL).collect()}
    assert back == {*enumerate(TEXTS), (None, "")}
    rows = S.round_trip(docs, MODEL)
    assert rows.count() == len(TEXTS) + 2
    want = {r[0]: r[1] for r in docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows.collect()} == want
    assert S.round_trip(docs.limit(0), MODEL).count() == 0


def test_long_words_without_spaces():
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for cost in (0.0, S.FEWEST):
        codec = S.PieceCodec(MODEL, cost)
        score = {i: p.get_score(i) - cost for i in range(p.get_piece_size())}
        vocabulary = {p.id_to_piece(i): (score[i], i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        r = random.Random(3)
        texts = ["".join(r.choice(alphabet) for _ in range(n)) for n, alphabet in ((511, "ethinrs"), (513, "ethinrs"), (1500, "ABCabc019+/"), (1600, "ab"), (900, "日本語中国人大学の"), (700, "thein日▁"), (257, "="))]
        for text, data in zip(texts, codec.encode(texts), strict=True):
            ids = np.frombuffer(data, "<i4").tolist()
            assert codec.decode([np.array(ids)]) == [text]
            best = brute(text, vocabulary, codec.byte_ids.tolist(), codec.low, codec.longest)
            assert ids == best
            assert cost == 0 or len(ids) <= len(p.encode(text)) or "▁" in text
        assert not any(len(w) > S.SHORT for w in codec.cache)


def test_a_million_characters_without_spaces(codec):
    r = random.Random(4)
    for alphabet in ("日本語中国人大学の一二三", "ABCDEFGHIJKLMabcdefghijklm0123456789+/"):
        text = "".join(r.choices(alphabet, k=1_000_000))
        assert codec.decode([np.frombuffer(codec.encode([text])[0], "<i4")]) == [text]
