"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 (clean), 1 and 2. Labels give toxic or not; a toxic
text is of grade 2 if it has more words that mark toxic texts than the median
toxic text. The model is P(grade > k) = sigmoid(w . x - t_k): all
thresholds share one weight vector, and t_0 <= t_1 keeps the grades ordered.
Features are words (letters, lower case) and word beginnings of ``PREFIXES``
letters, by 1 + log of their count; the vocabulary is every feature that tells toxic
from clean labels beyond chance (``LEAST_SURPRISE``), so scoring is a few dictionary
look-ups per distinct word. A document's score is its expected severity
P(> 0) + P(> 1), and it is toxic where P(> 0) is at least ``CUT``.

The model is fitted on at most ``SAMPLE`` labelled documents, chosen by hash of
doc_id; scoring reads every document.

Defined results: null texts are empty and score like the clean prior; labels that
repeat a doc_id count as toxic if one of them does; null labels are ignored;
without toxic or without clean labels every document scores 0 and is clean; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import map_arrow, texts

SAMPLE, LEAST_DOCS = 8_000, 5
PREFIXES = (4, 5, 6)
CUT = 0.2
LEAST_SURPRISE = 16.0  # log likelihood ratio, doubled
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def feature_counts(words: Counter, wanted: Container[str] | None = None) -> Counter:
    """Counts of the features of a text; of the ``wanted`` ones if given."""
    out: Counter = Counter()
    for word, n in words.items():
        for f in features(word):
            if wanted is None or f in wanted:
                out[f] += n
    return out


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, float] = (np.inf, np.inf)

    def exceeds(self, words: Counter) -> tuple[float, float]:
        """P(grade > 0) and P(grade > 1)."""
        found = feature_counts(words, self.weights)
        score = sum(self.weights[k] * (1 + np.log(found[k])) for k in sorted(found))
        return tuple(float(1 / (1 + np.exp(min(t - score, 700.0)))) for t in self.thresholds)


def _surprise(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of a feature's counts by label against one rate for both."""

    def fit_of(hits: np.ndarray, of: np.ndarray) -> np.ndarray:
        rate = np.clip(hits / of, 1e-12, 1 - 1e-12)
        return hits * np.log(rate) + (of - hits) * np.log(1 - rate)

    return 2 * (fit_of(seen, total[:, None]).sum(axis=0) - fit_of(seen.sum(axis=0), total.sum()))


def vocabulary(samples: list[tuple[Counter, int]]) -> dict[str, bool]:
    """The features whose document counts differ most between labels; true if they mark toxic texts."""
    total = np.array([sum(y == k for _, y in samples) for k in (0, 1)], float)
    seen = (Counter(), Counter())
    for counts, y in samples:
        seen[y].update({f for word in counts for f in features(word)})
    names = sorted(f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= LEAST_DOCS)
    times = np.array([[s[f] for f in names] for s in seen], float).reshape(2, -1)
    surprise = _surprise(times, total)
    best = [i for i in np.argsort(-surprise, kind="stable") if surprise[i] >= LEAST_SURPRISE]
    return {names[i]: bool(times[1, i] * total[0] > times[0, i] * total[1]) for i in best}


def grades(samples: list[tuple[Counter, int]], marking: dict[str, bool]) -> np.ndarray:
    """0 for clean texts, 1 for toxic ones, 2 for those with more marking words than the median toxic text."""
    marks = {w for w, toxic in marking.items() if toxic}
    times = np.array([sum(n for w, n in counts.items() if not marks.isdisjoint(features(w))) for counts, _ in samples])
    toxic = np.array([y for _, y in samples], bool)
    middle = np.median(times[toxic & (times > 0)]) if (toxic & (times > 0)).any() else np.inf
    return toxic.astype(int) + (toxic & (times > middle))


def fit(samples: list[tuple[Counter, int]], choose: float = 3.0, refit: float = 0.2) -> OrdinalModel:
    """A first fit chooses features: under a strong penalty words that merely come along get no weight.

    The second fit of what was chosen has little penalty, so that a single
    marking word can outweigh the prior.
    """
    if {y for _, y in samples} != {0, 1}:
        return OrdinalModel()
    marking = vocabulary(samples)
    y = grades(samples, marking)
    first = _descend(samples, y, list(marking), choose)
    return _descend(samples, y, list(first.weights), refit)


def _descend(samples: list[tuple[Counter, int]], y: np.ndarray, words: list[str], least: float, rounds: int = 500) -> OrdinalModel:
    """Accelerated proximal gradient on the mean log loss of both thresholds with the L1 penalty of ``least`` documents."""
    names = {w: i for i, w in enumerate(words)}
    found = ((i, names[w], 1 + np.log(n)) for i, (counts, _) in enumerate(samples) for w, n in feature_counts(counts, names).items())
    cells = np.fromiter(found, [("row", int), ("col", int), ("value", float)])
    row, col, value = cells["row"], cells["col"], cells["value"]
    above = np.stack([y > 0, y > 1]).astype(float)
    n, size = len(y), len(names)
    scale = np.sqrt(np.bincount(col, value**2, size) / n) if len(row) else np.ones(size)  # columns of one size converge together
    value = value / scale[col] if len(row) else value

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[col], n) if len(row) else np.zeros(n)

    def back(error: np.ndarray) -> np.ndarray:
        return np.bincount(col, value * error[row], size) if len(row) else np.zeros(size)

    top, probe = 1.0, np.ones(size)
    for _ in range(30):  # the largest curvature bounds the step
        probe = back(scores(probe)) / n
        top = max(np.linalg.norm(probe), 1e-9)
        probe = probe / top
    step, penalty = 1 / (0.5 * (top + 1)), least / n / scale
    start = np.array([np.log((1 - p) / p) for p in np.clip(above.mean(axis=1), 1e-3, 1 - 1e-3)])
    now = ahead = np.concatenate((np.zeros(size), start))
    momentum = 1.0
    for _ in range(rounds):
        w, t = ahead[:size], ahead[size:]
        error = (1 / (1 + np.exp(np.clip(t[:, None] - scores(w), -500, 500))) - above) / n
        new = ahead - step * np.concatenate((back(error.sum(axis=0)), -error.sum(axis=1)))
        new[:size] = np.sign(new[:size]) * np.maximum(np.abs(new[:size]) - step * penalty, 0)
        new[size:] = np.sort(new[size:])
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / later * (new - now)
        now, momentum = new, later
    return OrdinalModel({word: float(now[i] / scale[i]) for word, i in names.items() if now[i]}, (float(now[size]), float(now[size + 1])))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents; only their word counts reach the driver."""
    toxic = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    chosen = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = map_arrow(docs.select("doc_id", "text").join(chosen, "doc_id").select("y", "text"), _counted, "y int, words array<string>, times array<int>")
    once: dict[str, str] = {}  # the driver holds each word once, not once per sample
    samples = [(Counter(dict(zip((once.setdefault(w, w) for w in r.words), r.times, strict=True))), r.y) for r in rows.toLocalIterator()]
    return fit(sorted(samples, key=lambda s: (s[1], sorted(s[0].items())[:8])))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [word_counts(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["y", "words", "times"]
        )


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row per document: doc_id, p_mild (grade > 0), p_severe (grade > 1), severity, grade, toxic."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.exceeds(word_counts(t)) for t in texts(batch)]
            a, b = np.array(found, float).reshape(-1, 2).round(9).T
            grade = (a >= CUT).astype(np.int32) + ((a >= CUT) & (b >= 0.5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(a + b), pa.array(grade.astype(np.int32)), pa.array(a >= CUT)], ["doc_id", "p_mild", "p_severe", "severity", "grade", "toxic"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scored, "doc_id long, p_mild double, p_severe double, severity double, grade int, toxic boolean")


def reject(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.exceeds(word_counts(t))[0] < CUT for t in texts(batch)], pa.bool_()))

    return map_arrow(docs, clean, docs.schema)
