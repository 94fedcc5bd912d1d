"""Token counts by a whole-token shortcut.

Offline, on the driver, every string of the vocabulary is cut and merged on its own once. Those
that come out as one piece and one token are proven: wherever such a piece stands in a text, it is
one token. The proven strings are sent to the tasks; their pieces are counted without merging.
Only the other pieces are merged, each distinct one once as long as it is remembered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ANY, Vocabulary, _read, pieces

#: Merged pieces that a task remembers, and the longest of them, in characters.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 48
#: Bytes up to which all pairs of a piece are looked through for each merge.
SHORT = 64
#: Characters above which a text's pieces are taken one by one and not listed.
LISTED = 1 << 22


def merged_length(piece: bytes, byte_ids: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """How many tokens a piece has: the pair of lowest rank, the leftmost of equals, merges first."""
    symbols = [byte_ids[b] for b in piece]
    n = len(symbols)
    if n < 2:
        return n
    if n <= SHORT:
        return _short_length(symbols, ranks, made)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = ranks.get
    queue = [(r, k) for k in range(n - 1) if (r := rank(symbols[k] << 20 | symbols[k + 1])) is not None]
    heapq.heapify(queue)
    left = n
    while queue:
        r, k = heapq.heappop(queue)
        nxt = after[k]
        # A symbol that was merged away or has changed since leaves stale entries behind.
        if symbols[k] < 0 or nxt >= n or rank(symbols[k] << 20 | symbols[nxt]) != r:
            continue
        far, prev = after[nxt], before[k]
        symbols[k], symbols[nxt] = made[r], -1
        after[k] = far
        left -= 1
        if far < n:
            before[far] = k
            if (x := rank(symbols[k] << 20 | symbols[far])) is not None:
                heapq.heappush(queue, (x, k))
        if prev >= 0 and (x := rank(symbols[prev] << 20 | symbols[k])) is not None:
            heapq.heappush(queue, (x, prev))
    return left


def _short_length(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """The same for a few symbols, where looking through all pairs is quicker than a queue."""
    none = len(made)
    found = [ranks.get(a << 20 | b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
    while found and (r := min(found)) < none:
        k = found.index(r)
        symbols[k] = made[r]
        del symbols[k + 1], found[k]
        if k < len(found):
            found[k] = ranks.get(symbols[k] << 20 | symbols[k + 1], none)
        if k:
            found[k - 1] = ranks.get(symbols[k - 1] << 20 | symbols[k], none)
    return len(symbols)


def whole_tokens(vocabulary: Vocabulary) -> list[str]:
    """The strings of the vocabulary that are one piece and, merged alone, one token."""
    byte_ids, ranks, made = _rules(vocabulary)
    special = {vocabulary.special[s] for s in vocabulary.special}
    proven = []
    for i, raw in enumerate(vocabulary.tokens):
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # a part of a character: never a piece of a text
            continue
        if text and i not in special and pieces(text) == [text] and merged_length(raw, byte_ids, ranks, made) == 1:
            proven.append(text)
    return proven


def _rules(vocabulary: Vocabulary) -> tuple[list[int], dict[int, int], list[int]]:
    """Ids of the bytes, rank of each pair, id that each rank makes."""
    return vocabulary.byte_ids.tolist(), dict(zip(vocabulary.keys.tolist(), vocabulary.ranks.tolist(), strict=True)), vocabulary.made.tolist()


class _Counts(dict):
    """Tokens of a piece: 1 for the proven ones, merged when first seen for the others."""

    def __init__(self, proven: list[str], rules: tuple):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.rules = proven, rules

    def __missing__(self, piece: str) -> int:
        n = merged_length(piece.encode("utf-8", "surrogatepass"), *self.rules)
        if len(piece) <= REMEMBERED_LENGTH:
            self[piece] = n
        return n

    def trim(self) -> None:
        """Forgets the merged pieces if there are too many."""
        if len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))


def _split(text: str) -> Iterable[str]:
    return pieces(text) if len(text) <= LISTED else (m.group() for m in _ANY.finditer(text))


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a byte-level BPE vocabulary of the tokenizers library.

    One row for each row of the input: ``doc_id``, ``n_bytes`` (of the text in UTF-8), ``n_tokens``,
    ``over_limit`` (``n_tokens`` above ``limit``). The string of a special token counts as that one
    token, the library's default; no token is added at the ends. A null text counts as empty: 0
    bytes, 0 tokens. Null and repeated ids, and repeated rows, are each returned; an empty table
    gives no rows. Other columns, whatever their names, are not read. A text of any length is
    counted whole, its pieces one after the other.

    What is sent to the tasks is bounded by the vocabulary; what a task remembers by REMEMBERED.
    """
    spark = docs.sparkSession
    content = _read(spark, vocabulary_path)
    vocabulary = Vocabulary(content)
    sent = spark.sparkContext.broadcast((whole_tokens(vocabulary), _rules(vocabulary), vocabulary.splitter))
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proven, rules, splitter = sent.value
        counts = _Counts(proven, rules)
        tokens_of = counts.__getitem__

        def tokens(raw: bytes) -> int:
            text = raw.decode("utf-8", "replace")
            parts = splitter.split(text) if splitter else [text]
            return len(parts) // 2 + sum(sum(map(tokens_of, _split(part))) for part in parts[::2])

        for batch in batches:
            made = np.zeros(batch.num_rows, np.int64)
            size = np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(1)):
                if text.is_valid:
                    raw = text.as_buffer().to_pybytes()
                    size[k], made[k] = len(raw), tokens(raw)
                    counts.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(made)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = given.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
