"""Benchmark decontamination with an FM-index for each shard of the documents.

A task indexes its documents in shards of about SHARD words: words become numbers, all texts of
the shard one sequence with a separator before each text (and for words that no phrase has), and
the sequence is sorted by suffix.
The words before the sorted suffixes (the Burrows-Wheeler transform) are kept as a wavelet matrix,
one bit vector with ranks for each bit of a word number. A phrase is searched backward: two ranks
for each of its words narrow the interval of suffixes that start with it. Every SAMPLE-th position
is kept of the suffix order; the occurrences in an interval are located by stepping back in the
text to such a position. Spans of all occurrences are merged for each document.

The phrases are searched in blocks, so that what is sent to the tasks stays bounded whatever the
size of the benchmark. For more than one block the documents are stored once with a row number, by
which the spans of the blocks are put together; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store

#: Words of one index, beyond which the task starts another; a longer document stands alone.
SHARD = 1_000_000
#: Distance of the text positions that an index keeps.
SAMPLE = 8
#: Phrases that tasks get at a time.
PHRASES = 200_000
WINDOW = 10

_WORD_BYTES = frozenset(range(48, 58)) | frozenset(range(97, 123)) | frozenset(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of bytes from 0x80 on, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions of the sequence in the order of their suffixes, by prefix doubling.

    Each round sorts only the positions whose rank is shared with others.
    """
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(min(width, n)):
        key[: n - k] |= seq[k:].astype(np.int64) << (bits * (width - 1 - k))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    length = width
    while True:
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, n])
        tied = np.repeat(size > 1, size)
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        at = order[slots]
        after = at + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[at]
        o = np.lexsort((second, first))
        at, first, second = at[o], first[o], second[o]
        order[slots] = at
        new[slots] = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        head = np.where(new[slots], slots, 0)
        rank[at] = np.maximum.accumulate(head)
        length *= 2


class FMIndex:
    """Backward search and location over a sequence of numbers; 0 separates texts."""

    def __init__(self, seq: np.ndarray, largest: int):
        n = self.n = len(seq)
        order = suffix_order(seq)
        last = seq[order - 1]  # the word before each suffix; the sequence is taken as a circle
        self.bits = max(1, largest.bit_length())
        self.before = np.zeros(largest + 2, np.int64)
        self.before[1:] = np.cumsum(np.bincount(seq, minlength=largest + 1))
        self.ranks, self.zeros, self.starts = [], [], None
        current = last
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n - int(ones[-1]))
            current = np.concatenate([current[~bit], current[bit]])
        # Where the run of each number begins at the bottom of the matrix.
        begin = np.zeros(largest + 2, np.int64)
        first = np.flatnonzero(np.r_[True, current[1:] != current[:-1]])
        begin[current[first]] = first
        self.begin = begin
        self.kept = order % SAMPLE == 0
        self.kept_rank = np.r_[0, np.cumsum(self.kept)]
        self.samples = order[self.kept]
        self.last = last

    def rank(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each word stands among the first i of the transform."""
        i = i.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros, strict=True):
            one = (word >> level) & 1
            r = ones[i]
            i = np.where(one == 1, zeros + r, i - r)
        return i - self.begin[word]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that start with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            word = phrases[live, lengths[live] - 1 - step]
            base = self.before[word]
            low[live], high[live] = base + self.rank(word, low[live]), base + self.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, given by their place in the order."""
        rows, steps, place = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = self.kept[r]
            place[todo[done]] = self.samples[self.kept_rank[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            word = self.last[r]
            rows[todo] = self.before[word] + self.rank(word, r)
            steps[todo] += 1
        return place


def windows(text: bytes, size: int) -> list[tuple[bytes, ...]]:
    """All runs of so many words; the whole text if it has fewer, but not none."""
    words = split_words(text)
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]):
    """Row tags, texts as word numbers (0: a word of no phrase), for about SHARD words at a time."""
    tags, parts, held = [], [], 0
    number = vocabulary.get
    for batch in batches:
        for tag, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = split_words(text.as_buffer().to_pybytes()) if text.is_valid else []
            tags.append(tag)
            parts.append(np.array([number(w, 0) for w in words], np.int32))
            held += len(words)
            if held >= SHARD:
                yield tags, parts
                tags, parts, held = [], [], 0
    if tags:
        yield tags, parts


def _hits(batches: Iterator[pa.RecordBatch], phrases: list[tuple[bytes, ...]], owners: list[list[int]]):
    """Per document: id, words, start and end of the merged spans (in words), items found."""
    size = max(map(len, phrases), default=1)
    length = np.array([len(p) for p in phrases], np.int64)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for p in phrases for w in p), 1)}
    coded = np.full((len(phrases), size), -1, np.int64)
    for k, p in enumerate(phrases):
        coded[k, : len(p)] = [vocabulary[w] for w in p]
    for tags, parts in _shards(batches, vocabulary):
        counts = [len(part) for part in parts]
        sep = np.zeros(1, np.int32)
        # A separator ends the sequence too: the index takes it as a circle, and only where no two
        # separators meet do the steps back from row to row keep the order of the suffixes.
        whole = np.concatenate([*(x for part in parts for x in (sep, part)), sep])
        # No phrase goes over a word of none: such words are separators, and one in a row will do.
        used = (whole != 0) | np.r_[True, whole[:-1] != 0]
        place = np.flatnonzero(used)
        index = FMIndex(whole[used], len(vocabulary))
        low, high = index.search(coded, length)
        number = high - low
        rows = np.repeat(low, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        at = place[index.locate(rows)]
        which = np.repeat(np.arange(len(phrases)), number)
        first = np.cumsum(np.array(counts) + 1) - np.array(counts)  # of each document's words
        doc = np.searchsorted(first, at, side="right") - 1
        order = np.lexsort((at, doc))
        at, which, doc = at[order], which[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(tags) + 1))
        starts, ends, items = [], [], []
        for d in range(len(tags)):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                starts.append([]), ends.append([]), items.append([])
                continue
            s = at[a:b] - first[d]
            e = s + length[which[a:b]]
            reach = np.maximum.accumulate(e)
            new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
            starts.append(s[new].tolist())
            ends.append(reach[np.r_[new[1:] - 1, len(s) - 1]].tolist())
            items.append(sorted({i for k in np.unique(which[a:b]).tolist() for i in owners[k]}))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tags, pa.int64()), pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
             pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "starts", "ends", "items"],
        )


def _phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """Blocks of distinct windows and the items that own them, read row by row."""
    owners: dict[tuple[bytes, ...], list[int]] = {}
    rows = benchmark.where(benchmark[id_col].isNotNull() & benchmark[text_col].isNotNull())
    for item, text in rows.select(benchmark[id_col], benchmark[text_col].cast("binary")).toLocalIterator():
        for phrase in windows(bytes(text), window):
            owners.setdefault(phrase, []).append(item)
        if len(owners) >= PHRASES:
            yield list(owners), list(owners.values())
            owners = {}
    if owners:
        yield list(owners), list(owners.values())


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    One row for each document: doc_id, n_words, starts and ends (merged spans of hit words), items
    (sorted ids of the items with a window there). Null, empty and wordless texts have no words and
    no spans; items without words or with a null id or text have no windows. Repeated items and
    documents are taken one by one. A benchmark of several blocks of PHRASES windows is searched
    block by block; the spans of each row are then merged once more. An empty
    benchmark gives every document without spans. Other columns are not read.
    """
    given = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("binary"))
    ddl = "doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<bigint>"
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in _phrase_blocks(benchmark, item_col, item_text_col, window)]
    if not sent:
        return given.mapInArrow(lambda it: _hits(it, [(b"",)], [[]]), ddl)
    search = lambda rows, block: rows.mapInArrow(lambda it: _hits(it, *block.value), ddl)
    if len(sent) == 1:
        return search(given, sent[0])
    # Ids may be null or repeated: each row is searched by its own number, stored so that it stays the same.
    numbered = store(given.toDF("id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    one = search(numbered.select("row", "text"), sent[0])
    for block in sent[1:]:
        one = one.union(search(numbered.select("row", "text"), block))
    one = one.withColumnRenamed("doc_id", "row")
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<starts:bigint,ends:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= x["starts"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = one.groupBy("row", "n_words").agg(joined.alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.join(numbered.select("row", F.col("id").alias("doc_id")), "row")
    return merged.select("doc_id", "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_FREE = bytes(0 if b in _WORD_BYTES or 65 <= b <= 90 else 1 for b in range(256))


def cut_words(text: str, starts, ends) -> str:
    """The text without the words of the spans, and without what stands between them in a span."""
    if text is None or starts is None or not len(starts):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    free = np.frombuffer(raw.translate(_FREE), np.uint8)
    word = np.r_[0, (free == 0).astype(np.int8), 0]
    begin, end = np.flatnonzero(np.diff(word) == 1), np.flatnonzero(np.diff(word) == -1)
    parts, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        parts.append(raw[last : begin[s]])
        last = end[e - 1]
    parts.append(raw[last:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, starts, ends, other columns): the text without the words of the spans."""
    for batch in batches:
        texts, starts, ends = (batch.column(k).to_pylist() for k in range(3))
        cut = [cut_words(*x) for x in zip(texts, starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), *batch.columns[3:]], names=["text", *batch.schema.names[3:]])
