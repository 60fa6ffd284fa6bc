"""Removal of repeated byte strings with an enhanced suffix array.

A byte goes if a string of ``LENGTH`` bytes (a window) that covers it also starts
anywhere else, in the same document or another. Windows that can have an equal are
found from coarse to fine, each level by combining counts before any shuffle:

1. Pieces. A window's anchor is its ``K``-byte string of least hash (the first of
   equals), so equal windows hold the same anchor at the same distance. Neighbouring
   windows with one anchor form a piece; every window lies in exactly one. A piece
   whose anchor occurs nowhere else is done. One that occurs twice repeats as a whole.
2. Ranges. Where an anchor has several pieces, one of each is cut into ranges of at
   most ``STEP`` windows whose distances from the anchor share a quotient. All windows
   of a range hold the same ``SHARED`` bytes; a range whose shared bytes occur nowhere
   else is done, and one that occurs twice repeats as a whole.
3. Suffixes. What is left are ranges that share their middle with other ranges, but
   not their sides. Each of their windows starts a suffix. Suffixes are range-sorted
   over the cluster, so that all that agree in ``LENGTH`` bytes lie in one partition
   and in order, with the bytes that the last one shares with the next: an enhanced
   suffix array. A stack of open common-prefix intervals is kept while a task streams
   through it. An interval of at least ``LENGTH`` bytes, whose suffixes have different
   bytes on their left, is a maximal repeat and is given with all its occurrences.

No step gathers a group: groups of any size are counted, joined or streamed. An
equality join with a hot side is split by Spark. The shared bytes of a range are
named by 64 bits of their hash, the sides are compared byte by byte.

Defined results: null texts are empty; texts shorter than ``LENGTH`` lose nothing;
rows that repeat a doc_id, or have none, are texts of their own and their strings
repeat each other; an empty table gives an empty table; other columns are not read.
Texts are known by their content, not by a row number, so that nothing shifts when
a lost executor's rows are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rolling import prefix_sums, span_hashes
from tidewell.llm.text import map_arrow
from tidewell.sources.tables import discard, settle

LENGTH, K, STEP = 200, 32, 8
REACH = LENGTH - K  # the largest distance of a window's start from its anchor
SHARED = LENGTH - STEP + 1
_MASK = (1 << 64) - 1


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by block-wise running minima."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.uint64(_MASK), np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's distance from the first, anchor's hash) of a text's pieces, in order."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    own = span_hashes(prefix_sums(data), slice(0, n - K + 1), slice(K, n + 1))
    least = _sliding_least(own, REACH + 1)
    ends = (least[1:] != least[:-1]) | (own[: len(least) - 1] == least[:-1])  # the anchor leaves the window, or a lesser one enters
    last = np.append(np.flatnonzero(ends), len(least) - 1)
    first = np.append(0, last[:-1] + 1)
    anchor = last.copy()
    inside = np.flatnonzero(own[last] != least[last])
    for part in np.array_split(inside, len(inside) // 4096 + 1):
        near = np.lib.stride_tricks.sliding_window_view(own, REACH + 1)[last[part]]
        anchor[part] = last[part] + (near == least[last[part]][:, None]).argmax(axis=1)
    return first, last - first + 1, anchor - first, own[anchor]


def _utf8(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _context(data: bytes, at: int, n: int, lead: int) -> int:
    """The hash of a piece: its bytes and its anchor's place among them."""
    return xxhash.xxh3_64_intdigest(data[at : at + n - 1 + LENGTH], lead)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, lengths, contexts = [], [], []
        for data in _utf8(batch):
            parts.append(pieces(np.frombuffer(data, np.uint8)))
            lengths.append(len(parts[-1][0]))
            at, n, lead, _ = parts[-1]
            contexts += [_context(data, *x) for x in zip(at.tolist(), n.tolist(), lead.tolist(), strict=True)]
        if not contexts:
            continue
        at, n, lead, anchor = (np.concatenate(c) for c in zip(*parts, strict=True))
        row = np.repeat(np.arange(len(lengths)), lengths)
        of_text = [batch.column(c).take(pa.array(row)) for c in ("row", "check")]
        numbers = [pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(lead.astype(np.int16)), pa.array(anchor.view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([*of_text, *numbers], ["row", "check", "at", "n", "lead", "anchor", "context"])


def ranges(n: int, lead: int) -> list[tuple[int, int, int]]:
    """(quotient, least, largest distance from the anchor) of each range of a piece."""
    low = lead - n + 1
    return [(q, max(low, STEP * q), min(lead, STEP * q + STEP - 1)) for q in range(low // STEP, lead // STEP + 1)]


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text and its wanted pieces to a row for each piece, with its bytes and, for each range, the hashes of the shared bytes and of all.

    Copies of a text come to one task, or few, and are looked at once there.
    """
    h = xxhash.xxh3_64_intdigest
    names = ["anchor", "context", "n", "lead", "whole", "bytes", "middles", "extents"]
    kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for data, wanted, key in zip(_utf8(batch), batch.column("wanted").to_pylist(), zip(batch.column("row").to_pylist(), batch.column("check").to_pylist(), strict=True), strict=True):
            if key in seen:
                continue
            seen.add(key)
            for x in wanted:
                at, n, lead, anchor = x["at"], x["n"], x["lead"], x["anchor"]
                here = at + lead
                cut = ranges(n, lead)
                middles = [h(data[here - STEP * q : here - STEP * q + SHARED], (anchor + q) & _MASK) for q, _, _ in cut]
                extents = [h(data[here - high : here - low + LENGTH], (low - STEP * q) * STEP + high - STEP * q) for q, low, high in cut]
                row = (anchor, x["context"], n, lead, x["whole"], data[at : at + n - 1 + LENGTH], np.array(middles, np.uint64).view(np.int64), np.array(extents, np.uint64).view(np.int64))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece and its wanted ranges to a row for each window: what lies on either side of the shared bytes, and the byte before (-1: the range begins)."""
    names = ["middle", "extent", "distance", "side", "before"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for n, lead, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("n", "lead", "bytes", "wanted")), strict=True):
            cut = ranges(n, lead)
            for x in wanted:
                q, low, high = cut[x["place"]]
                start, end = lead - STEP * q, lead - low + LENGTH
                for d in range(low, high + 1):
                    side = data[lead - d : start] + data[start + SHARED : end]
                    for column, value in zip(out, (x["middle"], x["extent"], d, side, -1 if d == high else data[lead - d - 1]), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.int16()], strict=True)], names)


def common_bytes(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common at their start."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


class IntervalTree:
    """The open common-prefix intervals of a suffix array that is read in order.

    Each interval is [length, members, byte on the left, whether it is diverse].
    :meth:`add` takes the next suffix with the bytes it shares with the one before,
    and returns the maximal repeats of at least ``least`` bytes that end there, as
    (length, all members). A suffix whose left byte is -1 differs from all others.
    """

    def __init__(self, least: int):
        self.least = least
        self.stack: list[list] = []
        self.last: tuple | None = None

    def add(self, member: object, byte: int, shared: int) -> list[tuple[int, list]]:
        closed = self._close(shared)
        self.last = (member, byte)
        return closed

    def _close(self, shared: int) -> list[tuple[int, list]]:
        """Put the suffix read last where it belongs, now that its common prefix with the next is known."""
        if self.last is None:
            return []
        member, byte = self.last
        members, diverse, found = [member], byte < 0, []
        while self.stack and self.stack[-1][0] > shared:
            length, own, left, mixed = self.stack.pop()
            members = own + members
            diverse = diverse or mixed or left != byte
            if diverse:
                found.append((length, members))
        if self.stack and self.stack[-1][0] == shared:
            top = self.stack[-1]
            top[1] += members
            top[3] = top[3] or diverse or top[2] != byte
        elif shared >= self.least:
            self.stack.append([shared, list(members), byte, diverse])
        return found

    def end(self) -> list[tuple[int, list]]:
        closed = self._close(0)
        self.last = None
        return closed


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order to the occurrences of their maximal repeats: (repeat, length, middle, extent, distance)."""
    tree, seen, number = IntervalTree(LENGTH), None, 0
    kinds = [pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.int16()]

    def rows(closed: list[tuple[int, list]]) -> list[tuple]:
        nonlocal number
        out = []
        for length, members in closed:
            number += 1
            out += [(number, length, *m) for m in members]
        return out

    def record(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["repeat", "length", "middle", "extent", "distance"])

    for batch in batches:
        out: list[tuple] = []
        for middle, extent, distance, side, before in zip(*(batch.column(c).to_pylist() for c in ("middle", "extent", "distance", "side", "before")), strict=True):
            shared = SHARED + common_bytes(seen[2], side) if seen and seen[:2] == (middle, distance) else 0
            out += rows(tree.add((middle, extent, distance), before, shared))
            seen = (middle, distance, side)
        yield record(out)
    yield record(rows(tree.end()))


def _text_key() -> tuple[Column, Column]:
    """96 bits that know a text; equal texts lose the same bytes and may share them."""
    return F.xxhash64("text").alias("row"), F.hash("text").alias("check")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` (row, check, at, n, lead, anchor, context) and ``spans`` (anchor, context, repeat, first, last).

    A span is a repeated string that lies in a piece, its places counted from the
    anchor; pieces occur where ``found`` has them. ``repeat`` names strings that are
    equal (a piece or range that repeats as a whole, or a maximal repeat).
    """
    texts = docs.select("text", *_text_key())
    every = settle(map_arrow(texts.select("row", "check", "text"), _piece_rows, "row long, check int, at int, n short, lead short, anchor long, context long"), "pieces")
    # counts are settled, so that Spark may split a hot anchor's rows in the join
    again = settle(every.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "again")
    found = settle(every.join(again, "anchor", "left_semi"), "anchored")
    discard(every)

    contexts = settle(found.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("row", "check", "at", "n", "lead")).alias("one")), "contexts")
    several = settle(contexts.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "several")
    open_ = contexts.join(several, "anchor", "left_semi").select("one.*", "anchor", "context", (F.col("times") > 1).alias("whole"))
    wanted = open_.groupBy("row", "check").agg(F.collect_list(F.struct("anchor", "context", "at", "n", "lead", "whole")).alias("wanted"))
    cut = map_arrow(
        texts.join(wanted.hint("shuffle_hash"), ["row", "check"]),
        _range_rows, "anchor long, context long, n short, lead short, whole boolean, bytes binary, middles array<long>, extents array<long>",
    )
    cut = settle(cut.withColumn("piece", F.monotonically_increasing_id()), "ranges")

    each = cut.select("piece", F.posexplode(F.arrays_zip("middles", "extents")).alias("place", "x")).select("piece", "place", "x.middles", "x.extents").toDF("piece", "place", "middle", "extent")
    middles = each.groupBy("middle").agg(F.count("*").alias("times"), (F.min("extent") < F.max("extent")).alias("mixed")).filter("times > 1").drop("times")
    middles = settle(middles, "middles")
    shared = settle(each.join(middles, "middle"), "shared")
    extents = settle(shared.groupBy("middle", "extent", "mixed").agg(F.count("*").alias("times"), F.min(F.struct("piece", "place")).alias("one")), "extents")

    per_piece = extents.filter("mixed").groupBy("one.piece").agg(F.collect_list(F.struct("middle", "extent", "one.place")).alias("wanted"))
    suffixes = settle(map_arrow(cut.select("piece", "n", "lead", "bytes").join(per_piece, "piece").drop("piece"), _suffix_rows, "middle long, extent long, distance short, side binary, before short"), "suffixes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    array = suffixes.repartitionByRange(parts, "middle", "distance", F.substring("side", 1, STEP - 1)).sortWithinPartitions("middle", "distance", "side")
    maximal = map_arrow(array, _scan, "repeat long, length short, middle long, extent long, distance short")
    maximal = maximal.select("middle", "extent", F.xxhash64("repeat", F.spark_partition_id()).alias("repeat"), (-F.col("distance")).cast("int").alias("first"), (F.col("length") - F.col("distance")).cast("int").alias("last"))
    equal = extents.filter("times > 1").select("middle", "extent", F.xxhash64("middle", "extent").alias("repeat"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    hits = shared.select("middle", "extent", "piece", "place").join(equal.unionByName(maximal), ["middle", "extent"])

    least = F.col("lead") - F.col("n") + 1
    quotient = F.floor(least / STEP) + F.col("place")
    low, high = F.greatest(least, STEP * quotient), F.least(F.col("lead"), STEP * quotient + STEP - 1)
    in_parts = hits.join(cut.filter("NOT whole").select("piece", "anchor", "context", "n", "lead"), "piece")
    in_parts = in_parts.select("anchor", "context", "repeat", F.coalesce("first", -high).cast("int").alias("first"), F.coalesce("last", LENGTH - low).cast("int").alias("last"))
    in_whole = contexts.filter("times > 1").select("anchor", "context", F.xxhash64("anchor", "context").alias("repeat"), (-F.col("one.lead")).cast("int").alias("first"), (F.col("one.n") - 1 + LENGTH - F.col("one.lead")).cast("int").alias("last"))
    return found, settle(in_whole.unionByName(in_parts), "spans")


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Repeated strings of at least ``LENGTH`` bytes with all their occurrences: repeat, length, doc_id, start.

    A repeat that reaches beyond a piece is given in parts that overlap.
    """
    found, spans = repeats(docs)
    at = found.join(spans, ["anchor", "context"]).select("row", "check", "repeat", (F.col("last") - F.col("first")).alias("length"), (F.col("at") + F.col("lead") + F.col("first")).alias("start")).distinct()
    return docs.select("doc_id", *_text_key()).join(at, ["row", "check"]).select("repeat", "length", "doc_id", "start")


def union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of spans, given in order of ``first``; spans that touch are one run."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    begins = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return first[begins], reach[np.append(begins[1:] - 1, len(first) - 1)]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        offsets, values = spans.offsets.to_numpy(), spans.values.to_numpy()
        out = []
        for k, data in enumerate(_utf8(batch)):
            own = np.sort(values[offsets[k] : offsets[k + 1]])
            if not len(own):
                out.append((len(data), 0, 0, data))
                continue
            first, last = union(own >> 32, own & 0xFFFFFFFF)
            edges = [0, *np.stack((first, last), axis=1).ravel().tolist(), len(data)]
            rest = b"".join([data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
            out.append((len(data), len(data) - len(rest), len(first), rest))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and ``kept``, the remaining bytes."""
    found, spans = repeats(docs)
    whole = spans.groupBy("anchor", "context").agg(F.collect_set(F.struct("first", "last")).alias("own"))  # at most one for each pair of a piece's windows
    here = F.col("at") + F.col("lead")
    placed = found.join(whole, ["anchor", "context"]).select("row", "check", F.transform("own", lambda s: F.shiftleft((here + s["first"]).cast("long"), 32) + here + s["last"]).alias("own"))
    of_text = placed.select("row", "check", F.explode("own").alias("span")).groupBy("row", "check").agg(F.collect_set("span").alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", *_text_key()).join(of_text.hint("shuffle_hash"), ["row", "check"], "left")
    return map_arrow(rows.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans")), _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
