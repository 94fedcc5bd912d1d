"""Toxicity classifier: a factorization machine over hashed terms.

A text's terms are its words, the first letters of longer words, and, where such a beginning comes
again, how large a share of the text's words has it; terms are hashed into 2^18 buckets, and only
whether a bucket occurs counts. The model adds a weight for each bucket and, for each pair of
buckets, the product of their short vectors: an insult together with the mention of a group can
weigh more than both alone. Buckets that tell nothing about the label in the training rows are
left out; that is counted over all of them, the weights are fitted to a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, store

BUCKETS = 1 << 18
#: Buckets that the model may use, the most telling ones.
TERMS = 4096
#: Labelled texts that weights are fitted to: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
FACTORS, STEPS, RATE, DECAY, BATCH = 4, 1200, 0.1, 2e-4, 256
#: A bucket occurs in so many training texts at least, and has this likelihood-ratio statistic.
LEAST, TELLING = 3, 15.0
#: Letters of a word's beginnings, and shares of the words from which a repeated one has a term.
BEGINNINGS = (4, 5, 7)
SHARES = (1 / 256, 1 / 128, 1 / 64)
_KEEP = frozenset(range(48, 58)) | frozenset(range(97, 123)) | frozenset(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


class _Terms(dict):
    """Buckets of a word: its own, then those of its beginnings."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        text = word.decode("utf-8", "replace").lower()
        forms = (text, *(f"{text[:k]}~" for k in BEGINNINGS if len(text) >= k))
        self[word] = found = tuple(xxhash.xxh3_64_intdigest(f) % BUCKETS for f in forms)
        return found


def buckets(raw: bytes, terms: _Terms) -> np.ndarray:
    """The sorted buckets of a text's terms."""
    words = raw.translate(_FOLD).split()
    found: set[int] = set()
    often: dict[int, int] = {}
    for word, n in Counter(words).items():
        own, *begin = terms[word]
        found.add(own)
        for b in begin:
            often[b] = often.get(b, 0) + n
    found.update(often)
    again = [(b, n / len(words)) for b, n in often.items() if n > 1]
    for level, share in enumerate(SHARES, 1):
        # Another bucket for each share: an odd multiplier moves the number of the beginning's own.
        found.update((b * 0x9E3779B1 + level * 0x5BD1E995 >> 3) % BUCKETS for b, of_all in again if of_all >= share)
    return np.array(sorted(found), np.int64)


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _of_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = _Terms()
    for batch in batches:
        found = [buckets(_raw(t), terms).astype(np.int32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "terms", "label"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, texts with label 1, other texts) of a task; bucket -1 counts all texts."""
    n = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        for found, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n[int(label > 0), np.frombuffer(found, np.int32)] += 1
            n[int(label > 0), BUCKETS] += 1
    some = np.flatnonzero(n.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(some == BUCKETS, -1, some)), pa.array(n[1, some]), pa.array(n[0, some])], names=["bucket", "yes", "no"])


def _telling(yes: np.ndarray, no: np.ndarray, all_yes: float, all_no: float) -> np.ndarray:
    """The likelihood-ratio statistic of each bucket and the label."""
    n = all_yes + all_no
    total = np.zeros(len(yes))
    for part, label in ((yes, all_yes), (no, all_no)):
        for seen, size in ((part, yes + no), (label - part, n - yes - no)):
            with np.errstate(divide="ignore", invalid="ignore"):
                term = seen * np.log(seen * n / (size * label))
            total += np.where(seen > 0, term, 0)
    return 2 * total


@dataclass
class Machine:
    """Bucket numbers, their weights and vectors, and the constant."""

    place: np.ndarray
    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def known(self, found: np.ndarray) -> np.ndarray:
        at = self.place[found]
        return at[at >= 0]

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(r) for r in rows])
        of = np.repeat(np.arange(len(rows)), size)
        at = np.concatenate([*rows, np.empty(0, np.int64)])
        z = self.constant + np.bincount(of, self.weights[at], len(rows))
        for v in self.vectors.T:
            s = np.bincount(of, v[at], len(rows))
            z += 0.5 * (s * s - np.bincount(of, v[at] ** 2, len(rows)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, place: np.ndarray, terms: int) -> Machine:
    """Stochastic descent with steps by accumulated squares; rows hold places of telling buckets."""
    rng = np.random.default_rng(7)
    mean = (y.sum() + 1) / (len(y) + 2)
    m = Machine(place, float(np.log(mean / (1 - mean))), np.zeros(terms), rng.normal(0, 0.01, (terms, FACTORS)))
    if not len(y) or y.min() == y.max():
        m.vectors[:] = 0
        return m
    gw, gv = np.full(terms, 1e-6), np.full((terms, FACTORS), 1e-6)
    for _ in range(-(-STEPS // -(-len(y) // BATCH))):
        order = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            pick = order[b : b + BATCH]
            part = [rows[k] for k in pick]
            error = m.score(part) - y[pick]
            size = np.array([len(r) for r in part])
            of = np.repeat(np.arange(len(part)), size)
            at = np.concatenate([*part, np.empty(0, np.int64)])
            if not len(at):
                continue
            m.constant -= RATE * 0.1 * error.mean()
            used = np.unique(at)
            e = error[of]
            g = np.bincount(at, e, terms)[used] / len(pick) + DECAY * m.weights[used]
            gw[used] += g * g
            m.weights[used] -= RATE * g / np.sqrt(gw[used])
            for f in range(FACTORS):
                v = m.vectors[at, f]
                s = np.bincount(of, v, len(part))[of]
                g = np.bincount(at, e * (s - v), terms)[used] / len(pick) + DECAY * m.vectors[used, f]
                gv[used, f] += g * g
                m.vectors[used, f] -= 0.3 * RATE * g / np.sqrt(gv[used, f])
    return m


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """Scores every document: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Learns from the labelled ids that are not held out, TRAIN_ROWS of them at most (a bounded
    sample by hash of the id; at equal hashes a class of ids is in or out as a whole): which buckets
    tell something is counted over them, and weights are fitted to them. Null, empty and
    wordless texts have no terms and get the score of the constant. Null labels and unknown ids are
    passed over; equal labels of an id count once; of rows that repeat an id one is learned from.
    Without labels of both kinds (or any) all scores are equal. Rows are kept one by one, with null
    or repeated ids too; an empty table gives no rows; other columns are not read.
    """
    given = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    # The sample is of a fixed size; the texts it names are made into terms where they are read.
    chosen_ids = labelled_sample(labels, TRAIN_ROWS, id_col, label_col)
    train = given.join(F.broadcast(chosen_ids), "doc_id").select("doc_id", "text", "label").mapInArrow(_of_labelled, "doc_id bigint, terms binary, label double")
    train = store(train.groupBy("doc_id", "label").agg(F.min("terms").alias("terms")), "terms")
    counts = train.select("terms", "label").mapInArrow(_counted, "bucket bigint, yes bigint, no bigint").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counted = counts.toPandas()  # a row for each bucket at most
    whole = counted[counted.bucket == -1]
    seen = counted[(counted.bucket >= 0) & (counted.yes + counted.no >= LEAST)]
    place = np.full(BUCKETS, -1, np.int64)
    if len(whole) and len(seen):
        g = _telling(seen.yes.to_numpy(float), seen.no.to_numpy(float), float(whole.yes.iloc[0]), float(whole.no.iloc[0]))
        order = np.lexsort((seen.bucket.to_numpy(), -g))[:TERMS]
        best = seen.bucket.to_numpy()[order[g[order] >= TELLING]]
        place[best] = np.arange(len(best))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lambda at: at[at >= 0])(place[np.frombuffer(t, np.int32)]).astype(np.int32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), *batch.columns[1:]], names=["terms", "label", "doc_id"])

    sample = train.select("terms", "label", "doc_id").mapInArrow(chosen, "terms binary, label double, doc_id bigint").toPandas()
    sample = sample.sort_values(["doc_id", "label"])  # files come in any order; the steps of the fit should not
    rows = [np.frombuffer(bytes(t), np.int32).astype(np.int64) for t in sample.terms]
    model = fit(rows, (sample.label.to_numpy(np.float64) > 0).astype(float), place, TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            found = [model.known(buckets(_raw(t), terms)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(found))], names=["doc_id", "score"])

    scored = given.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
