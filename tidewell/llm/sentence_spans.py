r"""Removal of sentences that lie in repeated runs of sentences, and of repeated passages.

Words are ``[^\x20\x09-\x0D]+``. A sentence ends with a word that ends in ``.``, ``!``
or ``?``, or at a line end. Every run of ``SPAN`` consecutive sentences with at least
``WORDS`` words is hashed (96 bits of its words, whatever the white space between),
runs meet globally by hash, and all sentences of every run but the first go. First is
the least doc_id, then the earliest place in the text.

A passage need not hold whole sentences, so the words of a text are also cut by
content: before each word that has the least hash of some ``WINDOW`` consecutive
words. Two copies of a passage are cut alike from the first window that lies inside
it to the last. From every cut the shortest run of at least ``PASSAGE`` words that
ends at a cut is hashed, and to every cut the shortest one that begins at a cut. So
wherever ``PASSAGE + 2 * WINDOW - 1`` words (51) occur again, all go but at most
``WINDOW - 1`` at the front and ``WINDOW`` at the end.

Each batch of texts first keeps one run of each hash, the least; the others are known
not to be first and go on under their text's own key. So a hot run meets as one row per
batch, all runs are shuffled once, and are ranked within their hash by one sort, without
a join. A batch must be cut alike when a task is run again, as it is for a table's files.

Defined results: null texts are empty; runs within one text repeat too; rows that
repeat a doc_id are texts of their own, but rows that repeat both doc_id and text
are one text and fare alike; a null doc_id comes first; an empty table gives an empty
table; other columns are not read; ``n_removed`` counts sentences that lose a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.rolling import prefix_sums, span_hashes
from tidewell.llm.text import map_arrow
from tidewell.sources.tables import settle

SPAN, WORDS = 3, 8
WINDOW, PASSAGE = 10, 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes begin and end."""
    gap = np.concatenate(([True], _SPACE[data], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def sentence_starts(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first word of each sentence, and the number of words."""
    if not len(start):
        return np.zeros(1, np.int64)
    lines = np.cumsum(np.append(0, data == ord("\n")))
    ends = _STOP[data[stop[:-1] - 1]] | (lines[start[1:]] > lines[stop[:-1]])
    return np.concatenate(([0], np.flatnonzero(ends) + 1, [len(start)]))


def _extreme(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """The extreme of every ``WINDOW`` neighbours."""
    return pick.reduce(np.lib.stride_tricks.sliding_window_view(x, WINDOW), axis=1)


def cuts(weights: np.ndarray) -> np.ndarray:
    """The places before which words of these hashes are cut by content, with both ends."""
    n = len(weights)
    if n < WINDOW:
        return np.array([0, n])
    edge = np.zeros(WINDOW - 1, np.uint64)
    chosen = weights == _extreme(np.concatenate((edge, _extreme(weights, np.minimum), edge)), np.maximum)
    return np.unique(np.concatenate(([0], np.flatnonzero(chosen), [n])))


def runs(data: np.ndarray, start: np.ndarray, stop: np.ndarray, passages: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the runs of a text that are hashed."""
    sentences = sentence_starts(data, start, stop)
    a, b = sentences[:-SPAN], sentences[SPAN:]
    enough = b - a >= WORDS
    if not passages:
        return a[enough], b[enough]
    at = cuts(span_hashes(prefix_sums(data), start, stop))
    end = np.searchsorted(at, at + PASSAGE)
    begin = np.searchsorted(at, at - PASSAGE, side="right") - 1
    first = np.concatenate((a[enough], at[end < len(at)], at[begin[begin >= 0]]))
    last = np.concatenate((b[enough], at[end[end < len(at)]], at[begin >= 0]))
    pairs = np.unique((first << 32) + last)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _run_rows(batches: Iterator[pa.RecordBatch], passages: bool) -> Iterator[pa.RecordBatch]:
    """A row for each run; ``later`` where a lesser run of its hash lies in the same batch, with the text's key in place of the hash."""
    h = xxhash.xxh3_128_digest
    for batch in batches:
        places, sizes, lengths, digests = [], [], [], []
        for text in _bytes(batch):
            data = np.frombuffer(text, np.uint8)
            start, stop = words_of(data)
            first, last = runs(data, start, stop, passages) if len(start) else (np.zeros(0, np.int64),) * 2
            plain = b" ".join(text.split())
            at = np.append(0, np.cumsum(stop - start + 1))  # where each word begins in ``plain``
            digests += [h(plain[a : z - 1]) for a, z in zip(at[first].tolist(), at[last].tolist(), strict=True)]
            places.append(first)
            sizes.append(last - first)
            lengths.append(len(first))
        if not digests:
            continue
        row = np.repeat(np.arange(len(lengths)), lengths)
        place, size = np.concatenate(places).astype(np.int32), np.concatenate(sizes).astype(np.int32)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        high, low = halves[:, 0], halves[:, 1].astype(np.int32)
        doc_id, check = batch.column("doc_id"), batch.column("check").to_numpy()
        text_order = _numbered(doc_id, check)
        order = np.lexsort((place, text_order[row], low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        least = order[np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(order))))]
        later = np.empty(len(order), bool)
        later[order] = (text_order[row][order] != text_order[row][least]) | (place[order] != place[least])
        own = (check.astype(np.int64) << 32) ^ doc_id.fill_null(0).to_numpy()
        high, low = np.where(later, own[row], high), np.where(later, place, low)
        yield pa.RecordBatch.from_arrays(
            [doc_id.take(pa.array(row)), pa.array(check[row], pa.int32()), pa.array(place), pa.array(size), pa.array(high), pa.array(low), pa.array(later)],
            ["doc_id", "check", "place", "words", "high", "low", "later"],
        )


def _numbered(doc_id: pa.Array, check: np.ndarray) -> np.ndarray:
    """Numbers of a batch's texts in the order of (doc_id, check), equal for rows that are equal in both."""
    missing = doc_id.is_null().to_numpy(zero_copy_only=False)
    ids = doc_id.fill_null(0).to_numpy()
    order = np.lexsort((check, ids, ~missing))
    new = (ids[order][1:] != ids[order][:-1]) | (missing[order][1:] != missing[order][:-1]) | (check[order][1:] != check[order][:-1])
    out = np.empty(len(check), np.int64)
    out[order] = np.append(0, np.cumsum(new))
    return out


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        offsets, values = spans.offsets.to_numpy(), spans.values.to_numpy()
        out = []
        for k, text in enumerate(_bytes(batch)):
            data = np.frombuffer(text, np.uint8)
            start, stop = words_of(data)
            sentences = sentence_starts(data, start, stop)
            own = values[offsets[k] : offsets[k + 1]]
            if not len(own):
                out.append((len(sentences) - 1, 0, text.decode()))
                continue
            change = np.zeros(len(start) + 1, np.int64)
            np.add.at(change, own >> 32, 1)
            np.add.at(change, (own >> 32) + (own & 0xFFFFFFFF), -1)
            gone = np.cumsum(change[:-1]) > 0
            begins = np.flatnonzero(gone & ~np.append(False, gone[:-1]))
            ends = np.flatnonzero(gone & ~np.append(gone[1:], False)) + 1
            edges = [0, *np.stack((start[begins], np.append(start, len(text))[ends]), axis=1).ravel().tolist(), len(text)]
            lost = np.add.reduceat(gone.astype(np.int64), sentences[:-1]) > 0
            out.append((len(sentences) - 1, int(lost.sum()), b"".join([text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]).decode()))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string()], strict=True))], ["doc_id", "n_sentences", "n_removed", "text"])


def remove_repeats(docs: DataFrame, passages: bool = True) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed and the remaining text; without ``passages`` by runs of whole sentences alone."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.hash("text").alias("check"))
    every = map_arrow(rows, partial(_run_rows, passages=passages), "doc_id long, check int, place int, words int, high long, low int, later boolean")
    order = W.partitionBy("later", "high", "low").orderBy("doc_id", "check", "place")
    again = every.withColumn("nth", F.rank().over(order)).filter("later OR nth > 1")
    span = F.shiftleft(F.col("place").cast("long"), 32) + F.col("words")
    spans = settle(again.groupBy("doc_id", "check").agg(F.collect_set(span).alias("spans")), "spans")
    of_text = spans.select(F.col("doc_id").alias("id"), F.col("check").alias("own"), "spans").hint("shuffle_hash")
    joined = rows.join(of_text, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("check") == F.col("own")), "left")
    return map_arrow(joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans")), _cleaned, "doc_id long, n_sentences long, n_removed long, text string")
