"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives a row of figures (FEATURES). Each figure is cut into bins at quantiles; the model
is a table of weights for each figure, and for some pairs of figures a table with two sides. It is
learned by cyclic boosting: in turn for each figure, a tree of two splits on that figure alone is
fitted to what is left of the error, and added to the table by a small rate. Pairs are chosen by
what a coarse grid of them still explains, and boosted in the same way. A score is the sum of the
bins that a text falls in, so a part of the table is scored by additions on arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, store

FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "other_letters", "lines", "stops", "commas",
    "distinct", "commonest", "next_same", "shouting", "odd_ends", "bars", "short_words", "repeated_lines", "symbol_runs",
)
#: Labelled texts that the tables are fitted to: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 6, 150, 60, 0.15


def describe(raw: bytes) -> list[float]:
    """The figures of a text; an empty one has zeros."""
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    upper, lower, digits, high = int(b[65:91].sum()), int(b[97:123].sum()), int(b[48:58].sum()), int(b[128:].sum())
    space = int(b[9:14].sum() + b[32])
    stops, commas = int(b[46]), int(b[44])
    symbols = n - upper - lower - digits - high - space - stops - commas
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    shout = sum(map(bytes.isupper, words))
    odd = sum(1 for w in counts if not (w[-1] >= 128 or 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] in b".,"))
    lines = [x for x in raw.split(b"\n") if x]
    short = sum(c for w, c in counts.items() if len(w) <= 2)
    runs = sum(raw.count(c * 3) for c in (b"!", b"#", b"$", b"%", b"&", b"*", b"?", b"-", b"="))
    return [
        np.log1p(n), np.log1p(m), (n - space) / m, upper / n, digits / n, symbols / n, high / n, len(lines) / m, stops / m, commas / m,
        len(counts) / m, max(counts.values(), default=0) / m, same / m, shout / m, odd / max(1, len(counts)), int(b[124]) / m,
        short / m, 1 - len(set(lines)) / max(1, len(lines)), runs / m,
    ]


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [describe(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], names=["doc_id", "figures", *batch.schema.names[2:]])


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    given = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("binary"), *(docs[c] for c in keep))
    return given.mapInArrow(_figures, "doc_id bigint, figures array<double>" + _kept(docs, keep))


def _kept(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


@dataclass
class Additive:
    """Bin edges and weights of figures, and of pairs of figures on coarse bins."""

    start: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        z = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            z += table[b[:, k]]
        for i, j, table in self.pairs:
            z += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best split of bins in two, and its place (bins before it)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -1.0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (-1.0, 0)


def _steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Weights of a tree of two splits over the bins."""
    gain, cut = _best_cut(g, h)
    if gain <= 0:
        return np.zeros(len(g))
    parts = [(0, cut), (cut, len(g))]
    second = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
    gain, at, a, b = max(second)
    if gain > 0:
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Weights of a tree that splits a grid of bins once by each side."""
    i, j = _best_cut(g.sum(1), h.sum(1))[1], _best_cut(g.sum(0), h.sum(0))[1]
    # The better start decides one side, then the other is cut for what that leaves.
    out = np.zeros_like(g)
    for a in (slice(0, i), slice(i, None)):
        cut = _best_cut(g[a].sum(0), h[a].sum(0))[1] or j
        for b in (slice(0, cut), slice(cut, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of figures x for labels y of 0 and 1; without both labels it is constant."""
    d = len(FEATURES)
    none = Additive(0.0, [np.empty(0)] * d, np.zeros((d, 1)), [])
    if not len(y):
        return none
    mean = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return Additive(float(np.log(mean / (1 - mean))), none.edges, none.tables, [])
    x = np.nan_to_num(x)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
    model = Additive(float(np.log(mean / (1 - mean))), edges, np.zeros((d, BINS)), [])
    b = model.bins(x)
    z = np.full(len(y), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slopes()
            step = RATE * _steps(np.bincount(b[:, k], g, BINS), np.bincount(b[:, k], h, BINS))
            model.tables[k] += step
            z += step[b[:, k]]
    g, h = slopes()
    gains = []
    for i in range(d):
        for j in range(i):
            cell = b[:, i] // 4 * BINS + b[:, j] // 4
            gg, hh = np.bincount(cell, g, BINS * BINS), np.bincount(cell, h, BINS * BINS)
            gains.append((float((gg**2 / (hh + 1)).sum()), i, j))
    model.pairs = [(i, j, np.zeros((BINS, BINS))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            cell = b[:, i] * BINS + b[:, j]
            step = RATE * _quarters(
                np.bincount(cell, g, BINS * BINS).reshape(BINS, BINS), np.bincount(cell, h, BINS * BINS).reshape(BINS, BINS)
            )
            table += step
            z += step[b[:, i], b[:, j]]
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every document: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Learns from the labelled ids that are not held out, TRAIN_ROWS of them at most (a bounded
    sample by hash of the id; at equal hashes a class of ids is in or out as a whole). Null and
    empty texts are scored like any other, by zeros. Labels of null or for unknown ids are passed
    over; equal labels of an id count once; of rows that repeat an id one is learned from. Without
    labels of both kinds (or any) the score is the same for all. Rows are kept one by one, with null
    or repeated ids too; an empty table gives no rows. ``keep`` names columns to carry along; others
    are not read.
    """
    made = store(figures(docs, id_col, text_col, keep), "figures")
    chosen = labelled_sample(labels, TRAIN_ROWS, id_col, label_col)
    joined = made.select("doc_id", "figures").join(F.broadcast(chosen), "doc_id")  # a sample of a fixed size
    sample = joined.groupBy("doc_id", "label").agg(F.min("figures").alias("figures")).toPandas().sort_values(["doc_id", "label"])
    model = fit(np.array(sample.figures.tolist(), np.float64).reshape(-1, len(FEATURES)), sample.label.to_numpy(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), *batch.columns[2:]], names=["doc_id", "score", *keep])

    scored = made.mapInArrow(run, "doc_id bigint, score double" + _kept(docs, keep))
    return scored.select(*keep, "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
