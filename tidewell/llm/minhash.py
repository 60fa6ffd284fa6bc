r"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct shingles (64-bit hashes of word pairs;
words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a text of fewer words
is one shingle). Documents with equal sets form a class, whose least doc_id
stands for it. Of ``MINIMA`` minima per class, groups of ``ROWS`` give ``BANDS``
band hashes, and the low ``BITS`` bits of each are kept as packed bit planes. Pairs that share a band are estimated by bit
counts, corrected for chance agreement, and those within ``MARGIN`` (six
standard deviations) of the threshold are confirmed by intersecting the sets.
Of pairs at the threshold, 1 in 3.5 million shares no band.

Buckets never emit all their pairs. In star rounds every member meets one pivot of
its bucket; a bucket whose members are then connected is done. Documents of the
buckets that still hold several components form clusters (documents that share
such a bucket). In a cluster the members outside its largest component meet all
others in bounded blocks, where whole sets are intersected and only links leave
the block, at most one per member and component.

What is joined grows with the corpus, so every join is told to merge: a side that Spark
broadcast as small enough would pass through the driver's memory.

Defined results: null texts and texts without words have an empty set and link
with nothing; a null doc_id is a component of its own with a null id; rows that
repeat a doc_id count as one document for links; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import connected_components
from tidewell.llm.rolling import mix, word_hashes
from tidewell.llm.text import map_arrow, texts
from tidewell.sources.tables import settle

ROWS, BANDS, BITS, MINIMA = 5, 38, 2, 192
PERCENT, MARGIN = 80, 0.23
STAR_ROUNDS, BLOCK = 2, 512
_RANDOM = np.random.default_rng(6)
_A = (_RANDOM.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_set(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = np.concatenate(([True], _SPACE[data], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, stop = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    words = word_hashes(data, start, stop)
    if len(words) == 1:
        return mix(words)
    return np.unique(mix(words[:-1] * np.uint64(3) + words[1:]))


def minima(shingles: np.ndarray) -> np.ndarray:
    """``MINIMA`` least values under as many permutations of 32-bit values."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(values), 1024):
        np.minimum(least, (values[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch in batches:
        counts, keys, bands, planes = [], [], [], []
        for text in texts(batch):
            own = shingle_set(text)
            counts.append(len(own))
            keys.append(np.array([mix(own).sum(dtype=np.uint64), mix(own ^ _KEY).sum(dtype=np.uint64), len(own)], np.uint64).tobytes())
            if not len(own):
                bands.append(None)
                planes.append(None)
                continue
            least = minima(own)
            wide = least[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
            h = seeds.copy()
            for r in range(ROWS):
                h = mix(h * _KEY + wide[:, r])
            bands.append(h.view(np.int64))
            planes.append(np.concatenate([np.packbits((least >> np.uint32(k)) & np.uint32(1)) for k in range(BITS)]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
            ["doc_id", "n", "key", "bands", "planes"],
        )


_KEY = np.uint64(0xD6E8FEB86659FD93)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingle_set(x).view(np.int64) for x in texts(batch)], pa.list_(pa.int64()))], ["doc_id", "shingles"])


def _alike(a: str, b: str) -> Column:
    """Whether sizes and bit counts allow a link between the classes ``a`` and ``b``."""
    words = MINIMA // 64
    agree = F.lit(MINIMA)
    for w in range(words):
        differ = None
        for k in range(BITS):
            x = F.col(f"{a}.planes")[k * words + w].bitwiseXOR(F.col(f"{b}.planes")[k * words + w])
            differ = x if differ is None else differ.bitwiseOR(x)
        agree = agree - F.bit_count(differ)
    chance = 0.5**BITS
    least = MINIMA * (chance + (1 - chance) * (PERCENT / 100 - MARGIN))
    return (agree >= least) & (100 * F.least(f"{a}.n", f"{b}.n") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    of_a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    of_b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b")
    return both.select("a", "b", F.size("set_a").alias("x"), F.size("set_b").alias("y"), F.size(F.array_intersect("set_a", "set_b")).alias("common")).filter(f"100 * common >= {PERCENT} * (x + y - common)").select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (bucket, doc_id, label) of the buckets whose members lie in several components."""
    if labels is None:
        labelled = members.withColumn("label", F.col("doc_id"))
    else:
        labelled = members.join(labels.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    # settled, so that a hot bucket's rows need not come to the task that counted them
    apart = settle(labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("bucket"), "apart")
    return labelled.join(apart.hint("merge"), "bucket", "left_semi")


def _star_pairs(mixed: DataFrame, seed: int) -> DataFrame:
    """Each member with its bucket's pivot, where they lie in different components."""
    order = F.col("doc_id") if not seed else F.xxhash64("doc_id", F.lit(seed))
    pivots = settle(mixed.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "label"), order).alias("p")), "pivots")
    met = mixed.join(pivots.hint("merge"), "bucket").filter("label != p.label")
    return met.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the two sides of each block; rows come sorted by block and side."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        left, right = ([r for r in rows if r[1] == k] for k in (0, 1))
        out = []
        if left and right:
            sizes = np.array([len(r[4]) for r in left])
            values, owner = np.concatenate([r[4] for r in left]), np.repeat(np.arange(len(left)), sizes)
            by = np.argsort(values, kind="stable")
            values, owner = values[by], owner[by]
            seen = set()
            for r in right:
                common = np.zeros(len(left), np.int64)
                for part in np.array_split(r[4], len(r[4]) // 4096 + 1):  # bounds what is held at once
                    first = np.searchsorted(values, part)
                    times = np.searchsorted(values, part, side="right") - first
                    hits = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    common += np.bincount(owner[hits], minlength=len(left))
                for k in np.flatnonzero(100 * common >= PERCENT * (sizes + len(r[4]) - common)):
                    if left[k][3] != r[3] and (left[k][2], r[3]) not in seen:
                        seen.add((left[k][2], r[3]))
                        out.append((left[k][2], r[2]))
        columns = list(zip(*out, strict=True)) if out else [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

    rows: list[tuple] = []
    for batch in batches:
        shingles = batch.column("shingles")
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "side", "doc_id", "label")), strict=True)):
            if rows and rows[-1][0] != row[0]:
                yield links(rows)
                rows = []
            rows.append((*row, shingles[k].values.to_numpy()))
    if rows:
        yield links(rows)


def _cluster_links(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) between components within each cluster of buckets."""
    pivots = settle(mixed.groupBy("bucket").agg(F.min("doc_id").alias("b")), "pivots")
    edges = mixed.join(pivots.hint("merge"), "bucket").filter("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    of = connected_components(edges).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    rows = settle(mixed.select("doc_id", "label").distinct().join(of.hint("merge"), "doc_id"), "clusters")
    sizes = rows.groupBy("cluster", "label").agg(F.count("*").alias("k")).groupBy("cluster")
    sizes = sizes.agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.sum("k").alias("all"), F.max("k").alias("largest"))
    # settled, so that a large cluster's rows need not come to the task that counted them
    sizes = settle(sizes.filter("all > 2"), "sizes")
    tagged = rows.join(sizes.hint("merge"), "cluster")  # the one pair of a smaller cluster has met
    many, fewer = F.ceil(F.col("all") / BLOCK), F.ceil((F.col("all") - F.col("largest")) / BLOCK)
    own = F.xxhash64("doc_id")

    def dealt(members: DataFrame, side: int, left: Column, right: Column) -> DataFrame:
        block = F.explode(F.sequence(F.lit(0).cast("long"), (right if side == 0 else left) - 1))
        here = F.pmod(own, left if side == 0 else right)
        apart = members.select("cluster", "doc_id", "label", here.alias("here"), block.alias("there"))
        first, second = ("here", "there") if side == 0 else ("there", "here")
        return apart.select(F.concat_ws(":", "cluster", first, second).alias("block"), F.lit(side).alias("side"), "doc_id", "label")

    blocks = dealt(tagged.filter("label != most"), 0, fewer, many).unionByName(dealt(tagged, 1, fewer, many))
    met = blocks.join(sets.hint("merge"), "doc_id").select("block", "side", "doc_id", "label", "shingles")
    return map_arrow(met.repartition("block").sortWithinPartitions("block", "side", "doc_id"), _meet, "a long, b long")


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (id, component) after the links ``found``; only the components that these join are looked at."""
    of_a, of_b = labels.toDF("a", "of_a"), labels.toDF("b", "of_b")
    between = found.join(of_a.hint("merge"), "a", "left").join(of_b.hint("merge"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = connected_components(between.filter("a <> b"))
    moved = labels.join(merged.toDF("component", "root").hint("merge"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return settle(moved.unionByName(merged.join(labels.hint("merge"), "id", "left_anti")), "labels")


def link(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    signed = settle(map_arrow(narrow, _signatures, "doc_id long, n long, key binary, bands array<long>, planes array<long>"), "signatures")
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n", "planes", "bands")).alias("c"))
    classes = settle(classes.select("key", "c.*"), "classes")
    buckets = classes.select("doc_id", F.explode("bands").alias("bucket"))
    shared = settle(buckets.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket"), "shared")
    members = settle(buckets.join(shared.hint("merge"), "bucket", "left_semi").distinct(), "buckets")
    known = classes.select("doc_id", "n", "planes")
    ids = members.select("doc_id").distinct()
    sets = settle(map_arrow(narrow.join(ids.hint("merge"), "doc_id", "left_semi"), _sets, "doc_id long, shingles array<long>"), "sets")
    side_a = known.select(F.col("doc_id").alias("a"), F.struct("n", "planes").alias("p"))
    side_b = known.select(F.col("doc_id").alias("b"), F.struct("n", "planes").alias("q"))
    mixed, labels = settle(_mixed(members, None), "mixed"), None
    for turn in range(STAR_ROUNDS + 1):
        if mixed.isEmpty():
            break
        if turn < STAR_ROUNDS:
            pairs = _star_pairs(mixed, turn).join(side_a.hint("merge"), "a").join(side_b.hint("merge"), "b").filter(_alike("p", "q")).select("a", "b")
            found = settle(_confirmed(pairs, sets), "links")
        else:
            found = settle(_cluster_links(mixed, sets), "links")
        if found.isEmpty():
            continue
        labels = connected_components(found) if labels is None else _joined(labels, found)
        if turn < STAR_ROUNDS:
            mixed = settle(_mixed(mixed.select("bucket", "doc_id"), labels), "mixed")
    of_class = classes.select("key", F.col("doc_id").alias("class_id"))
    if labels is not None:
        of_class = of_class.join(labels.hint("merge"), F.col("class_id") == F.col("id"), "left").select("key", F.coalesce("component", "class_id").alias("class_id"))
    rows = signed.select("doc_id", "n", "key").join(of_class.hint("merge"), "key", "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which one per component stays, with all their columns."""
    kept = link(docs).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


QUERY_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS a, unnest(range(len(ws))) AS i, len(ws) AS n FROM w),
sh AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN a ELSE a || ' ' || b END AS s
       FROM (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM tok) WHERE n = 1 OR b IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT b.b, reach.r FROM reach JOIN both_ways b ON b.a = reach.v)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, m.r AS component_id, d.doc_id = m.r AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON m.v = d.doc_id
"""
