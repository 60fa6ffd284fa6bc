"""SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary and its scores come from a model file. A text gets a leading space;
its words (spaces and what follows them) are segmented into the pieces with the
largest sum of scores. Words of equal length advance together: at every place the
hashes of the substrings that end there probe the sorted keys of the pieces of
that length, and the best one's length is stored as a back-pointer. Of equal sums
the shortest last piece wins. A character without a piece becomes its UTF-8 bytes
as byte pieces, at ``FALLBACK`` below the lowest score. No piece goes over the start of a
word, so words can be segmented alone and remembered. ``piece_cost`` is taken from
every score: the scores of a model trained by merging pairs are merge ranks, and with a
cost above them all (``FEWEST``) the ids are as few as the pieces allow.

A word of over ``SHORT`` characters is first cut between neighbours that no piece
holds side by side, which changes nothing. What is still longer than ``LONG`` is laid
out in blocks of ``BLOCK``: the best sums from each place where a piece may begin first
in a block to each such place of the next are found for all blocks together, then
chained; from these all blocks are swept again together, and the word is cut at one
bound in each. So texts without spaces take time in proportion to their length, and
get the pieces that one sweep would give.

Decoding looks up each id's bytes and drops the leading space; it gives the very
text back, white space and U+2581 included. The segmentation is that of maximal
score, which for a model trained by merging pairs need not be the merge order's.

Defined results: null and empty texts have no ids; unknown ids decode to nothing;
rows that repeat are coded each; an empty table gives an empty table; other
columns are kept by encode and decode, and not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rolling import mix
from tidewell.llm.text import map_arrow, texts

SPACE, FALLBACK, FEWEST = "▁", 10.0, 100_000.0
CACHED, TOGETHER = 400_000, 20_000
SHORT, LONG, BLOCK, BLOCKS = 48, 512, 256, 512
_WORDS = re.compile(r" *[^ ]+| +")
_NONE = np.uint64(0xFFFFFFFF)  # a literal U+2581, which no piece may match


class PieceCodec:
    def __init__(self, model: str, piece_cost: float = 0.0):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        by_length: dict[int, list[tuple[str, float, int]]] = defaultdict(list)
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or SPACE in piece.lstrip(SPACE):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                by_length[len(piece)].append((piece, p.get_score(i) - piece_cost, i))
        self.low = min(s for x in by_length.values() for _, s, _ in x) - FALLBACK
        self.longest = max(by_length)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.tables = {}
        for n, rows in by_length.items():
            points = np.array([[ord(c) for c in piece] for piece, _, _ in rows], np.uint64)
            keys = self._span(*self._prefix(points), 0, n)
            order = np.argsort(keys)
            self.tables[n] = (keys[order], np.array([s for _, s, _ in rows])[order], np.array([i for _, _, i in rows], np.int32)[order])
        neighbours = {(ord(a) << 32) + ord(b) for x in by_length.values() for piece, _, _ in x for a, b in zip(piece, piece[1:], strict=False)}
        self.neighbours = np.array(sorted(neighbours), np.uint64)
        self.cache: dict[str, bytes] = {}

    def _prefix(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = points.shape[1]
        up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, self.base, np.uint64))))
        down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(self.base), -1, 1 << 64)), np.uint64))))
        sums = np.zeros((len(points), n + 1), np.uint64)
        np.cumsum(mix(points + np.uint64(1)) * up[:n], axis=1, out=sums[:, 1:])
        return sums, down

    @staticmethod
    def _span(sums: np.ndarray, down: np.ndarray, start: int, stop: int) -> np.ndarray:
        return mix((sums[:, stop] - sums[:, start]) * down[start])

    @staticmethod
    def _points(text: str) -> np.ndarray:
        """Code points with the mark for spaces, and nothing's for a literal mark."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        return np.where(points == ord(" "), np.uint64(ord(SPACE)), np.where(points == ord(SPACE), _NONE, points))

    def _scores(self, sums: np.ndarray, down: np.ndarray, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(size, scores) of the substrings that end at a place of all rows."""
        for size in range(1, min(self.longest, stop) + 1):
            if size in self.tables:
                keys, scores, _ = self.tables[size]
                h = self._span(sums, down, stop - size, stop)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                yield size, np.where(keys[at] == h, scores[at], self.low if size == 1 else -np.inf)

    def _chain(self, points: np.ndarray) -> list[int]:
        """The first bound in each block but the first, on the segmentation that a sweep over the whole word finds."""
        n, longest = -(-len(points) // BLOCK), self.longest
        width = BLOCK + longest - 1
        padded = np.append(points, np.full(n * BLOCK + longest - 1 - len(points), _NONE))
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[::BLOCK]
        sums_to, own = [], np.arange(longest)
        for k in range(0, n, BLOCKS):
            prefix = self._prefix(rows[k : k + BLOCKS])
            best = np.full((width + 1, len(prefix[0]), longest), -np.inf)
            best[own, :, own] = 0
            for stop in range(1, width + 1):
                for size, score in self._scores(*prefix, stop):
                    np.maximum(best[stop], best[stop - size] + score[:, None], out=best[stop])
            if k == 0:
                begin = [best[:longest, 0, 0].copy()]
            sums_to.append(best[BLOCK:].transpose(1, 2, 0).copy())
        for block in np.concatenate(sums_to):
            begin.append((begin[-1][:, None] + block).max(axis=0))
        back = np.zeros(n * BLOCK + longest, np.uint8)
        for k in range(0, n, BLOCKS):
            prefix = self._prefix(rows[k : k + BLOCKS])
            count = len(prefix[0])
            best = np.full((width + 1, count), -np.inf)
            best[:longest] = np.stack(begin[k : k + count], axis=1)
            last = np.zeros((count, width + 1), np.uint8)
            for stop in range(longest, width + 1):
                for size, score in self._scores(*prefix, stop):
                    total = best[stop - size] + score
                    better = total > best[stop]
                    best[stop, better], last[better, stop] = total[better], size
            back[k * BLOCK + longest :][: count * BLOCK] = last[:, longest:].ravel()
        bounds, at, sizes = [], len(points), back.tobytes()
        while at >= BLOCK:
            bounds.append(at)
            at -= sizes[at]
        bounds = np.array(bounds[::-1])
        return np.unique(bounds[np.searchsorted(bounds, np.arange(BLOCK, len(points), BLOCK))]).tolist()

    def _parts(self, word: str) -> list[str]:
        """A long word cut where its segmentation has bounds."""
        points = self._points(word)
        pairs = (points[:-1] << np.uint64(32)) + points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
        bounds = [0, *(np.flatnonzero(self.neighbours[at] != pairs) + 1).tolist(), len(word)]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z - a > LONG:
                bounds += [a + c for c in self._chain(points[a:z]) if a + c < z]
        bounds = sorted(set(bounds))
        return [word[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]

    def _segment(self, words: list[str]) -> list[bytes]:
        """The ids of words of one length."""
        n = len(words[0])
        points = self._points("".join(words)).reshape(len(words), n)
        sums, down = self._prefix(points)
        best = np.full((len(words), n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(words), n + 1), np.int32)
        ids = np.full((len(words), n + 1), -1, np.int32)
        for stop in range(1, n + 1):
            for size in range(1, min(self.longest, stop) + 1):
                if size not in self.tables:
                    continue
                keys, scores, known = self.tables[size]
                h = self._span(sums, down, stop - size, stop)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                score = np.where(hit, scores[at], self.low if size == 1 else -np.inf) + best[:, stop - size]
                better = score > best[:, stop]
                best[better, stop], back[better, stop] = score[better], size
                ids[better, stop] = np.where(hit, known[at], -1)[better]
        places = np.full(len(words), n)
        steps = []
        rows = np.arange(len(words))
        while places.any():
            steps.append((places.copy(), np.where(places > 0, ids[rows, places], -2)))
            places = places - back[rows, places]
        out = []
        for r, word in enumerate(words):
            found: list[int] = []
            for place, own in reversed(steps):
                if own[r] >= 0:
                    found.append(int(own[r]))
                elif own[r] == -1:
                    found += self.byte_ids[list(word[place[r] - 1].encode("utf-8", "surrogatepass"))].tolist()
            out.append(np.array(found, "<i4").tobytes())
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """The little-endian 32-bit ids of each text."""
        split = [_WORDS.findall(" " + t) if t else [] for t in batch]
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = {w for words in split for w in words} - self.cache.keys()
        parts = {w: self._parts(w) for w in new if len(w) > SHORT}
        by_length = defaultdict(list)
        for word in new.difference(parts).union(*parts.values()) - self.cache.keys():
            by_length[len(word)].append(word)
        for n, words in by_length.items():
            most = max(1, min(TOGETHER, (1 << 21) // n))
            for i in range(0, len(words), most):
                part = words[i : i + most]
                self.cache.update(zip(part, self._segment(part), strict=True))
        self.cache.update([(w, b"".join(map(self.cache.__getitem__, p))) for w, p in parts.items()])
        out = [b"".join(map(self.cache.__getitem__, words)) for words in split]
        for word in [*parts, *(w for n, words in by_length.items() if n > SHORT for w in words)]:
            self.cache.pop(word, None)
        return out

    def decode(self, batch: list[np.ndarray]) -> list[str]:
        known = self.bytes_of
        return [b"".join([known[i] for i in ids.tolist() if 0 <= i < len(known)]).decode("utf-8", "replace")[1:] for ids in batch]


@lru_cache(1)
def _codec(model: str, piece_cost: float = 0.0) -> PieceCodec:
    return PieceCodec(model, piece_cost)


def encode(docs: DataFrame, model: str, piece_cost: float = 0.0) -> DataFrame:
    """``docs`` with ``ids`` in place of ``text``."""
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [np.frombuffer(x, "<i4") for x in _codec(model, piece_cost).encode(texts(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(coded, pa.list_(pa.int32()))], [*kept, "ids"])

    return map_arrow(docs.select(*kept, "text"), run, schema)


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with ``text`` in place of ``ids``."""
    kept = [c for c in coded.columns if c not in ("text", "ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields if f.name in kept), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(_codec(model).decode(ids), pa.string())], [*kept, "text"])

    return map_arrow(coded.select(*kept, "ids"), run, schema)


def round_trip(docs: DataFrame, model: str, piece_cost: float = 0.0) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32, and the sha256 of the text decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = _codec(model, piece_cost).encode(texts(batch))
            back = _codec(model, piece_cost).decode([np.frombuffer(x, "<i4") for x in coded])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array(back, pa.string())], ["doc_id", "n_ids", "ids_crc32", "text"])

    done = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_ids long, ids_crc32 long, text string")
    return done.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
