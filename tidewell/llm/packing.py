"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut into full pieces and a rest. Packing is
bulk-synchronous. In each round pieces are dealt evenly to tasks and sorted by
length; every task sweeps its pieces from the longest down, gives each to its
successor among the task's gaps (the smallest that holds it) and puts what is left
of the gap back among them; what finds no gap opens a sequence. Pieces of one length
and gaps of one size are swept together as runs, and ranks within a run decide which
piece goes to which gap, so no two want the same. After a round each task gives up
its emptiest sequences, at most ``RELEASED``; their pieces are dealt anew to an
eighth of the tasks, until one task is left, which has a few hundred sequences to
fill. So the loss of packing in parts is that of one part, and no task ever holds
more than its share of pieces: ``PER_TASK`` in the first round, 8 * ``RELEASED``
sequences later.

Defined results: a null text is empty and gives the end token alone; documents
that repeat a doc_id are packed once each; a null doc_id stays null; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import map_arrow, texts
from tidewell.sources.tables import settle

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHED, SHORT = 500_000, 48  # chunks that a worker remembers, and their characters
PER_TASK, RELEASED, FEWER = 500_000, 64, 8


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in printable)}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts, word by word, equal to those of the tokenizer on the text.

    The tokenizer lower-cases, drops white space and never merges over the bounds
    of its pre-tokens. So a batch of texts is cut at white space, each distinct chunk
    is looked up once, and new words are merged together: in every step each word of a
    length merges its pair of least rank. Texts with other characters than ``PLAIN``
    or with special tokens go to the tokenizer as they are.
    """

    PLAIN = re.compile(r"[\t\n\r -~¡-įı-ɏ‐-‧€]*")
    #: The tokenizer's pattern, for plain texts: contractions, letters, single numerals, other characters.
    PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
    LONGEST = 128  # bytes of a word that is merged here
    NEVER = np.int32(1 << 30)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary = model["vocab"]
        self.inner = np.array([vocabulary[c] for c in _byte_characters()], np.int64)
        self.final = np.array([vocabulary[c + model["end_of_word_suffix"]] for c in _byte_characters()], np.int64)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        pairs = np.array([(vocabulary[a] << 32) + vocabulary[b] for a, b in merges], np.int64)
        by = np.argsort(pairs)
        self.pairs, self.rank = pairs[by], by.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.chunks: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols among the merges."""
        pair = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], self.NEVER)

    def _merge(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of words of one length, as their merges come to an end; a step makes every open word one symbol shorter."""
        rows = np.arange(len(symbols))
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            open_ = least < self.NEVER
            if not open_.all():
                yield rows[~open_], symbols[~open_]
                rows, symbols, ranks, at, least = rows[open_], symbols[open_], ranks[open_], at[open_], least[open_]
            if not len(rows):
                return
            own, width = np.arange(len(rows)), symbols.shape[1]
            symbols[own, at] = self.merged[least]
            place = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, place + (place > at[:, None]), axis=1)
            place = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self._ranks(symbols[left, at[left] - 1], symbols[left, at[left]])
            ranks[right, at[right]] = self._ranks(symbols[right, at[right]], symbols[right, at[right] + 1])
        yield rows, symbols

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct lower-case words."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if len(data) > self.LONGEST:
                out[word] = self._slow(word)
            else:
                by_length.setdefault(len(data), []).append((word, data))
        for length, own in by_length.items():
            data = np.frombuffer(b"".join([d for _, d in own]), np.uint8).reshape(-1, length)
            symbols = self.inner[data]
            symbols[:, -1] = self.final[data[:, -1]]
            for rows, ids in self._merge(symbols):
                step = 4 * ids.shape[1]
                flat = ids.astype("<u4").tobytes()
                out.update((own[r][0], flat[i : i + step]) for r, i in zip(rows.tolist(), range(0, len(flat), step), strict=True))
        return out

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        if len(self.chunks) > CACHED:
            self.chunks.clear()
        new = [c for c in chunks if c not in self.chunks]
        parts = [[x] if x.isalpha() else self.PRE_TOKEN.findall(x) for x in (c.lower() for c in new)]
        words = self._words(list({w for p in parts for w in p}))
        learned = {c: b"".join([words[w] for w in p]) for c, p in zip(new, parts, strict=True)}
        self.chunks.update((c, ids) for c, ids in learned.items() if len(c) <= SHORT)
        return [learned[c] if c in learned else self.chunks[c] for c in chunks]

    def __call__(self, batch: list[str]) -> list[bytes]:
        """The little-endian 32-bit ids of each text."""
        plain = [bool(self.PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in batch]
        split = pc.ascii_split_whitespace(pa.array([t if p else "" for t, p in zip(batch, plain, strict=True)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        known = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        chunk = coded.indices.to_numpy()
        own = sizes[chunk]
        ends = np.cumsum(own)
        flat = pool[np.repeat((np.cumsum(sizes) - sizes)[chunk] - (ends - own), own) + np.arange(own.sum())]
        bounds = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [flat[a:b].tobytes() if p else self._slow(t) for t, p, a, b in zip(batch, plain, bounds[:-1], bounds[1:], strict=True)]


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                data += end
                for k, i in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[i : i + 4 * capacity]
                    rows.append((doc_id, k, i // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where runs of pieces go: (length, first rank, end rank, first sequence, pieces in each, offset).

    ``counts`` has the number of pieces of each length. Gaps of one size are
    intervals of sequences; a gap's size also tells how far its sequences are filled.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    sizes: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                n = -(-(end - rank) // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            size = sizes[i]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[i]
            each = size // length
            if end - rank < each:
                each, used = end - rank, 1
            else:
                used = min(n, (end - rank) // each)
            out.append((length, rank, rank + used * each, first, each, capacity - size))
            put(size, first + used, n - used)
            put(size - each * length, first, used)
            rank += used * each
    return out


def _fill(batches: Iterator[pa.RecordBatch], capacity: int, stage: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One task's round: pieces, longest first, with sequence_id, offset and whether they are given up again."""
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    pieces = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    length = pieces.column("length").to_numpy()
    begins = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
    counts = np.diff(np.append(begins, len(length)))
    runs = np.array(plan(dict(zip(length[begins].tolist(), counts.tolist(), strict=True)), capacity), np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    most = len(length) + 1
    rank = np.arange(len(length)) - np.repeat(begins, counts)
    run = runs[np.searchsorted(runs[:, 0] * most + runs[:, 1], length * most + rank, side="right") - 1]
    nth = rank - run[:, 1]
    sequence = run[:, 3] + nth // run[:, 4]
    offset = run[:, 5] + nth % run[:, 4] * length
    filled = np.bincount(sequence, weights=length)
    emptiest = np.argsort(filled, kind="stable")[:RELEASED]
    given_up = np.zeros(len(filled), bool)
    if not last:
        given_up[emptiest[filled[emptiest] < capacity]] = True
    first = (stage << 56) + (TaskContext.get().partitionId() << 32)
    columns = [*pieces.columns, pa.array(first + sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(given_up[sequence])]
    yield pa.RecordBatch.from_arrays(columns, [*pieces.schema.names, "sequence_id", "offset", "again"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a long ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, again boolean"
    order = [F.desc("length"), *(c for c in ("doc_id", "piece") if c in columns)]
    left = settle(pieces, "pieces")
    tasks = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // PER_TASK))
    done = []
    while True:
        dealt = left.repartition(tasks).sortWithinPartitions(*order)
        packed = settle(map_arrow(dealt, partial(_fill, capacity=capacity, stage=len(done), last=tasks == 1), schema), "packed")
        done.append(packed.filter("NOT again").drop("again"))
        if tasks == 1:
            return reduce(DataFrame.unionByName, done)
        left, tasks = packed.filter("again").select(columns), -(-tasks // FEWER)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids to training rows: sequence_id, ids, and each piece's (doc_id, piece, offset)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("pieces"))
