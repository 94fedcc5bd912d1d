"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (the last 32 of them count); a word ends a chunk where
the hash after it is 0 in its top bits. The cut so depends on the text nearby alone: an insertion
moves the chunks next to it, and all others stay the same. Chunks are compared by digest (95
bits);
the first of equal chunks (smallest doc_id, then place) is kept. A run of repeated chunks is
removed if it has at least ``min_words`` words: shorter ones are common phrases, not passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_ids, spread, store
from .words import U64, mix

#: A cut after one of so many words on average, as a power of two.
CUT_BITS = 2
#: Words of consecutive repeated chunks from which they are removed. A passage of more than 50
#: words loses up to a chunk at both ends, which it shares with the text around it.
MIN_WORDS = 20
_GEAR = (mix(np.arange(256, dtype=U64) + U64(1)) >> U64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text in bytes, and the number of words up to each.

    A chunk ends with the white space after its last word, so that chunks joined give the text.
    """
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # sums over the last 2, 4, ... 32 bytes
        older = np.zeros_like(h)
        older[shift:] = h[:-shift] << np.uint32(shift)
        h = h + older
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:])  # last byte of each word but the last
    chosen = (h[ends] >> np.uint32(32 - CUT_BITS)) == 0
    # A cut stands before the next word.
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    after = np.searchsorted(starts, ends[chosen], side="right")
    at = starts[after[after < len(starts)]]
    at = np.unique(np.r_[at, len(data)])
    words = np.cumsum(np.r_[~space[0], space[:-1] & ~space[1:]])
    return at, words[at - 1]


def _again(h: np.ndarray, lo: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digest, doc and place, and in that order whether an equal chunk stands elsewhere before."""
    order = np.lexsort((at, doc, lo, h))
    h, lo, doc, at = h[order], lo[order], doc[order], at[order]
    first = np.maximum.accumulate(np.where(np.r_[True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])], np.arange(len(h)), 0))
    return order, (doc != doc[first]) | (at != at[first])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, doc_id, at, again) of every chunk; at is its number in the text and its words.

    Chunks that repeat within the part of a task are known to be repetitions and keep no digest
    but a hash of their document, so a common chunk has one row to compare for each part.
    """
    ids, places, digests, held = [], [], [], 0

    def flush():
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        h, lo = d[:, 0].copy(), (d[:, 1] & 0x7FFFFFFF).astype(np.int32)
        doc, at = np.concatenate(ids), np.concatenate(places)
        order, again = _again(h, lo, doc, at)
        h, lo, doc, at = h[order], lo[order], doc[order], at[order]
        h[again] = mix(doc[again].view(U64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, lo, doc, at, again)], names=["hi", "lo", "doc_id", "at", "again"])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            end, upto = cuts(raw)
            begin = 0
            for e in end.tolist():
                digests.append(xxhash.xxh3_128_digest(raw[begin:e].rstrip()))
                begin = e
            ids.append(np.full(len(end), i, np.int64))
            places.append((np.arange(len(end)) << 32) | np.diff(np.r_[0, upto]))
            held += len(end)
            if held > 500_000:
                yield flush()
                ids, places, digests, held = [], [], [], 0
    if held:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by digest, doc and place: all but the first of each digest."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, at, again = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        again = again.copy()
        plain = np.flatnonzero(~again)
        if len(plain):
            # The first chunk of each digest; for the first digest it may be in the last batch.
            h, x, d, p = (c[plain] for c in (hi, lo, doc, at))
            start = np.maximum.accumulate(np.where(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])], np.arange(len(h)), 0))
            d0, p0 = d[start], p[start]
            if last is not None and last[:2] == (h[0], x[0]):
                d0[start == 0], p0[start == 0] = last[2:]
            again[plain] = (d != d0) | (p != p0)
            last = (h[-1], x[-1], d0[-1], p0[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(at[again])], names=["doc_id", "at"])


def _removed(at: np.ndarray, min_words: int) -> np.ndarray:
    """Of the repeated chunks (number and words), the numbers of those in runs that are long enough."""
    at = np.unique(at)
    p, w = at >> 32, at & 0xFFFFFFFF
    run = np.cumsum(np.r_[0, (np.diff(p) != 1).astype(np.int64)])
    return p[np.bincount(run, weights=w)[run] >= min_words]


def _cut(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(text, repeated chunks, other columns): the text without long runs of those chunks."""
    for batch in batches:
        texts, gone_words, spans = [], [], []
        for text, at in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else None
            gone = _removed(at.values.to_numpy(), min_words) if at.is_valid and raw else []
            if not len(gone):
                texts.append(raw)
                gone_words.append(0)
                spans.append([])
                continue
            end, upto = cuts(raw)
            begin = np.r_[0, end[:-1]]
            keep = np.ones(len(end), bool)
            keep[gone] = False
            texts.append(b"".join(raw[b:e] for b, e in zip(begin[keep], end[keep], strict=True)))
            gone_words.append(int(np.diff(np.r_[0, upto])[gone].sum()))
            edge = np.flatnonzero(np.diff(gone) != 1)
            spans.append([int(x) for pair in zip(begin[gone[np.r_[0, edge + 1]]], end[gone[np.r_[edge, len(gone) - 1]]], strict=True) for x in pair])
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(gone_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), *batch.columns[2:]],
            names=["text", "n_words_removed", "spans", *batch.schema.names[2:]],
        )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of the documents with repeated passages cut out of the text.

    Adds ``n_words_removed`` and ``spans`` (start and end of each removed run in UTF-8 bytes of
    the given text; such columns of the input are replaced). The first occurrence of a chunk, by
    doc_id and place, stays; a repetition within one document counts as well. Each row is taken on
    its own: those with a null id, and all but one row of a repeated id, come after the others, so of
    equal rows one keeps its text. Texts of null stay null. An empty table gives no rows.
    """
    reserved = {"n_words_removed", "spans", "_id", "_at", "_row"}
    rest = [c for c in docs.columns if c != text_col and c not in reserved]
    columns = docs.columns
    docs = row_ids(docs, id_col)
    given = docs.select("_row", docs[text_col].cast("binary"))
    ddl = "hi bigint, lo int, doc_id bigint, at bigint, again boolean"
    chunks = given.mapInArrow(_chunks, ddl).repartition("hi").sortWithinPartitions("hi", "lo", "doc_id", "at")
    again = chunks.mapInArrow(_repeated, "doc_id bigint, at bigint")
    per_doc = again.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("at").alias("_at"))
    per_doc = store(per_doc, "repeats")
    joined = docs.join(spread(per_doc), docs["_row"] == F.col("_id"), "left")
    out = joined.select(docs[text_col].cast("binary").alias("_text"), "_at", *(docs[c] for c in rest))
    ddl = ", ".join(["text string", "n_words_removed bigint", "spans array<bigint>", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)])
    cut = out.mapInArrow(lambda it: _cut(it, min_words), ddl)
    return cut.select(*(cut["text"].alias(text_col) if c == text_col else cut[c] for c in columns if c not in reserved), "n_words_removed", "spans")
