"""Target-distribution importance resampling with a head-tail vocabulary.

Texts are bags of hashed n-grams of words. A bucket's gain is the log ratio of its share in the
target texts to its share in the corpus; a document's weight is the sum of its features' gains,
and Gumbel noise, fixed by the id, turns the weights into a draw without replacement.

Hashing is CRC-32, which is linear: crc(A + B) is crc(A) moved over len(B) zero bytes, xor crc(B).
The head, words and word pairs that make up more than a fixed share of the corpus, is counted
once over all texts and sent to the tasks: words with their CRC, with and without the space that
follows, pairs with theirs. All other features, the tail, get their CRC directly: a word from its
bytes, a longer run by moving the CRC of its beginning over the rest. Which features are in the
head changes only the time it takes; head and tail both count in exact bucket totals.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.ordering import add_row_id

from .shared import store

#: Words and pairs are in the head if they are more than one in so many of all. So the head has at
#: most so many, and what is sent is at most HEAD_WORDS words of LONGEST bytes and HEAD_PAIRS pairs.
HEAD_WORDS, HEAD_PAIRS, LONGEST = 1 << 15, 1 << 16, 48
#: Bytes of text that are hashed at a time, and slots of the table of pairs.
PART, SLOTS = 4 << 20, 1 << 19
#: Lengths in bytes that have a ready table to move a CRC over; longer moves make theirs.
READY = 2 * LONGEST + 2

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes of other characters, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def _segments(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in parts, and how many of them are the last words of the part before."""
    if len(text) <= PART:
        yield split_words(text), 0
        return
    plain, begin, carried = text.translate(_LOWER), 0, []
    while begin < len(plain):
        end = plain.find(b" ", begin + PART)
        end = len(plain) if end < 0 else end
        words = carried + plain[begin:end].split()
        yield words, len(carried)
        carried, begin = words[-2:], end


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    for k, text in enumerate(batch.column(column)):
        if text.is_valid:
            yield k, text.as_buffer().to_pybytes()


# The head: a summary of fixed size in each task, added up over all tasks.


def _prune(counted: Counter, keep: int) -> Counter:
    """The keep largest counters, all lowered by the next one (Misra and Gries, 1982)."""
    if len(counted) <= keep:
        return counted
    values = np.fromiter(counted.values(), np.int64, len(counted))
    cut = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({g: n - cut for g, n in counted.items() if n > cut})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters (gram, pair, n) of a task's frequent words and pairs; n is never over the true count.

    A gram of null holds the number of all words and pairs.
    """
    words, pairs, total = Counter(), Counter(), [0, 0]
    for batch in batches:
        for _, text in _texts(batch, 0):
            for found, carried in _segments(text):
                words.update(found[carried:])
                pairs.update(zip(found, found[1:], strict=False))
                total[0] += len(found) - carried
                total[1] += max(0, len(found) - 1)
                if len(words) > 4 * HEAD_WORDS:
                    words = _prune(words, 2 * HEAD_WORDS)
                if len(pairs) > 4 * HEAD_PAIRS:
                    pairs = _prune(pairs, 2 * HEAD_PAIRS)
    one = [(w, n) for w, n in _prune(words, 2 * HEAD_WORDS).items() if len(w) <= LONGEST]
    two = [(a + b" " + b, n) for (a, b), n in _prune(pairs, 2 * HEAD_PAIRS).items() if max(len(a), len(b)) <= LONGEST]
    for kind, found in enumerate((one, two)):
        if total[kind]:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *(g for g, _ in found)], pa.binary()), pa.array([kind == 1] * (len(found) + 1)), pa.array([total[kind], *(n for _, n in found)], pa.int64())],
                names=["gram", "pair", "n"],
            )


def head_of(docs: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Frequent words and frequent pairs of a table of texts.

    A word (pair) that is more than 1.5 in HEAD_WORDS (HEAD_PAIRS) of all is always found; as the
    counters add up to no more than all words, there can't be more than HEAD_WORDS of them.
    """
    counted = store(docs.select("text").mapInArrow(_frequent, "gram binary, pair boolean, n bigint").groupBy("gram", "pair").agg(F.sum("n").alias("n")), "head")
    total = {r.pair: r.n for r in counted.where("gram is null").collect()}
    words, pairs = (
        sorted(bytes(r.gram) for r in counted.where((F.col("pair") == pair) & F.col("gram").isNotNull() & (F.col("n") * most > total.get(pair, 0))).select("gram").collect())
        for pair, most in ((False, HEAD_WORDS), (True, HEAD_PAIRS))
    )
    return words, pairs


# CRC-32 over many features at a time.


@functools.cache
def _move(length: int) -> np.ndarray:
    """For each byte of a CRC (low first) and its 256 values, what it is after so many zero bytes."""
    if length == 0:
        return (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    if length == 1:
        byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        same = _move(0)
        return byte[same & np.uint32(255)] ^ (same >> np.uint32(8))
    half = _move(length // 2)
    whole = _moved(half, half)
    return _moved(whole, _move(1)) if length % 2 else whole


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@functools.cache
def _ready() -> list[np.ndarray]:
    return list(np.stack([_move(n) for n in range(READY + 1)], axis=1).reshape(4, -1))


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from those of A and B and the length of B in bytes."""
    at = np.minimum(length, READY) << 8
    t = _ready()
    out = t[0][at + (first & 255)] ^ t[1][at + (first >> 8 & 255)] ^ t[2][at + (first >> 16 & 255)] ^ t[3][at + (first >> 24)]
    for n in np.unique(length[length > READY]).tolist():
        far = length == n
        out[far] = _moved(first[far], _move.__wrapped__(n))
    return out ^ second


class Head:
    """The frequent words and pairs as tables; ``pairs`` may hold words that ``words`` lacks."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        self.number = {w: k for k, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.spaced = np.array([zlib.crc32(w + b" ") for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.codes = np.full(SLOTS, -1, np.int64)
        self.pair_crc = np.zeros(SLOTS, np.uint32)
        both = [(self.number[a], self.number[b], p) for p in pairs for a, b in [p.split(b" ")] if a in self.number and b in self.number]
        if both:
            code = np.array([a << 32 | b for a, b, _ in both], np.int64)
            at = self._slot(code)
            self.codes[at] = code
            # Of pairs that fall on one slot one stays; the others are tail.
            own = self.codes[at] == code
            self.pair_crc[at[own]] = np.array([zlib.crc32(p) for _, _, p in both], np.uint32)[own]

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64)

    def pair_crcs(self, a: np.ndarray, b: np.ndarray, spaced: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of each pair of neighbours: looked up, else the first word's moved over the second."""
        code = a << 32 | b
        at = self._slot(code)
        out = self.pair_crc[at]
        tail = np.flatnonzero(self.codes[at] != code)
        x, y = a[tail], b[tail]
        out[tail] = joined(spaced[x], crc[y], length[y])
        return out


class _Numbers(dict):
    """Numbers of the words of a part: those of the head, then new ones."""

    def __init__(self, head: Head):
        super().__init__(head.number)
        self.tail: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.tail.append(word)
        return k


def _hashed(parts: list[tuple[list[bytes], int]], head: Head, buckets: int):
    """Of words, pairs and triples: the bucket of the run that ends at each word, and if there is one."""
    numbers = _Numbers(head)
    ids = np.concatenate([np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words, _ in parts])
    tail = numbers.tail
    crc = np.r_[head.crc, np.array([zlib.crc32(w) for w in tail], np.uint32)].astype(np.uint32)
    spaced = np.r_[head.spaced, np.array([zlib.crc32(w + b" ") for w in tail], np.uint32)].astype(np.uint32)
    length = np.r_[head.length, np.array([len(w) for w in tail], np.int64)].astype(np.int64)
    sizes = np.array([len(words) for words, _ in parts], np.int64)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    carried = np.repeat(np.array([c for _, c in parts], np.int64), sizes)
    yield (crc[ids] % np.uint32(buckets)).astype(np.int64), place >= carried
    if len(ids) < 2:
        return
    a, b = ids[:-1], ids[1:]
    pair = head.pair_crcs(a, b, spaced, crc, length)
    yield np.r_[0, (pair % np.uint32(buckets)).astype(np.int64)], place >= np.maximum(carried, 1)
    if len(ids) < 3:
        return
    triple = joined(spaced[a[:-1]], pair[1:], length[a[1:]] + 1 + length[b[1:]])
    yield np.r_[0, 0, (triple % np.uint32(buckets)).astype(np.int64)], place >= np.maximum(carried, 2)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[tuple[list[bytes], int]]]]:
    """Row numbers and segments with at least a word, for about PART bytes at a time."""
    rows, parts, held = [], [], 0
    for k, text in _texts(batch, column):
        for words, carried in _segments(text):
            if len(words) > carried:
                rows.append(k)
                parts.append((words, carried))
                held += min(len(text), PART)
                if held >= PART:
                    yield rows, parts
                    rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def bucket_totals(texts: DataFrame, head, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; ``head`` is a broadcast (words, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Head(*head.value), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, parts in _parts(batch, 0):
                for bucket, there in _hashed(parts, known, buckets):
                    total += np.bincount(bucket[there], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the log ratio of its smoothed shares, rounded down."""
    n = len(corpus)
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draws ``percent`` of the documents so that their n-grams are distributed as in ``target``.

    One row for each row of ``docs``: ``doc_id``, ``n_features`` (runs of 1 to 3 words), ``weight``
    (sum of the features' gains), ``score`` (weight plus Gumbel noise from a hash of seed and id),
    ``rank``: 1, 2, 3... for the drawn ones by falling score, null for the others. Drawn are the
    floor(percent * N / 100) highest scores of the N documents of at least ``least_words`` words;
    ties go to smaller ids, a null id last, rows of one id by weight, then number of features; equal
    rows get ranks of their own. ``target`` has a column ``text``.

    A null or empty text has no words: weight 0, never drawn. A null id takes the noise of an empty
    one. An empty ``docs`` gives no rows; an empty ``target`` gives all buckets equal target shares.
    Other columns, whatever their names, are not read. Long texts are hashed whole, in parts that
    share two words.

    The driver holds the head (bounded by HEAD_WORDS and HEAD_PAIRS) and one number a bucket.
    """
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    wanted = target.select(F.col("text").cast("binary").alias("text"))
    sc = docs.sparkSession.sparkContext
    head = sc.broadcast(head_of(given))
    gain = sc.broadcast(gains(bucket_totals(given, head, buckets), bucket_totals(wanted, head, buckets)))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, worth = Head(*head.value), gain.value
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)  # words, features, weight
            for rows, parts in _parts(batch, 1):
                ends = np.cumsum([len(words) for words, _ in parts])
                for k, (bucket, there) in enumerate(_hashed(parts, known, buckets)):
                    features = np.diff(np.r_[0, np.cumsum(there)[ends - 1]])
                    weight = np.diff(np.r_[0, np.cumsum(np.where(there, worth[bucket], 0))[ends - 1]])
                    np.add.at(made[1], rows, features)
                    np.add.at(made[2], rows, weight)
                    if k == 0:
                        np.add.at(made[0], rows, features)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = given.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = store(weighed.withColumn("score", F.col("weight") + noise), "scored")
    long_enough = F.col("n_words") >= least_words
    ranked = add_row_id(scored.where(long_enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], "rank")
    drawn = scored.where(long_enough).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    first = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.union(scored.where(~long_enough).select(*columns, F.lit(None).cast("bigint").alias("rank")))
