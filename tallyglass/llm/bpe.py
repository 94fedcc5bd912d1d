"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task takes its texts in parts of about PART bytes and splits them into pieces. The distinct
pieces of a part become one sequence of symbols, linked both ways. An index maps every pair of
neighbours that has a rank to all its positions. Ranks are applied in ascending order: all
positions of a pair are merged at once, and the pairs that this makes at both sides are added to
the lists of their ranks. A merge only makes pairs of higher ranks, so each rank comes up once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are encoded at a time.
PART = 24 << 20
#: The pattern that splits text into pieces (fixed value).
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for texts of ASCII and Latin letters, where plain classes do.
_LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(r"[\t-\r -~ªºÀ-ÖØ-öø-ɏ]*")
_PLAIN_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def pieces(text: str) -> list[str]:
    return (_PLAIN_PIECES if _PLAIN.fullmatch(text) else _ANY).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones as they are."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """A vocabulary file of the tokenizers library of the byte-level kind."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in model["vocab"].items():
            self.tokens[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = model["vocab"][letter]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.left, self.right = keys >> 20, keys & 0xFFFFF
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # Pieces that stand for themselves wherever they occur, longest first.
        names = sorted(self.special, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 if it has none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        first = np.cumsum(sizes) - sizes
        before[first[sizes > 0]] = -1
        after[(first + sizes - 1)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            known = ranks >= 0
            ranks, places = ranks[known], places[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            edge = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *edge.tolist(), len(ranks)]
            for r, a, b in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(active, r)

        p = np.flatnonzero(after >= 0)
        add(self.rank(sym[p], sym[after[p]]), p)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = np.concatenate(lists) if len(lists) > 1 else lists[0]
            left, right, made = int(self.left[r]), int(self.right[r]), int(self.made[r])
            nxt = after[p]
            p = p[(sym[p] == left) & (nxt >= 0) & (sym[nxt] == right)]
            if left == right and len(p):
                p = _apart(np.unique(p), after)
            if not len(p):
                continue
            nxt = after[p]
            far = after[nxt]
            sym[p], sym[nxt] = made, -1
            after[p] = far
            has = far >= 0
            before[far[has]] = p[has]
            prev = before[p]
            q = prev[prev >= 0]
            both = np.concatenate([q, p[has]])
            add(self.rank(sym[both], sym[after[both]]), both)
        live = sym >= 0
        return sym[live], np.bincount(word[live], minlength=len(words))


def _apart(p: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places of a pair of equal symbols, from the left, those that don't overlap."""
    chained = np.r_[False, after[p[:-1]] == p[1:]]
    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
    return p[(np.arange(len(p)) - start) % 2 == 0]


@functools.lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def encode(texts: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of every text."""
    number: dict[str, int] = {}
    special: dict[int, int] = {}
    coded = []
    for text in texts:
        parts = vocabulary.splitter.split(text) if vocabulary.splitter else [text]
        found: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:  # a special token
                code = number.setdefault("\0" + part, len(number))
                special[code] = vocabulary.special[part]
                found.append(code)
            else:
                split = pieces(part)
                for piece in split:
                    if piece not in number:
                        number[piece] = len(number)
                found.extend(map(number.__getitem__, split))
        coded.append(np.array(found, np.int64))
    words = [b"" if k in special else w.encode("utf-8", "surrogatepass") for k, w in enumerate(number)]
    ids, sizes = vocabulary.merge(words)
    if special:
        at = np.array(sorted(special), np.int64)
        ids = np.insert(ids, (np.cumsum(sizes) - sizes)[at], [special[k] for k in at.tolist()])
        sizes[at] = 1
    begin = np.cumsum(sizes) - sizes
    out = []
    for c in coded:
        count = sizes[c]
        total = int(count.sum())
        at = np.repeat(begin[c] - (np.cumsum(count) - count), count) + np.arange(total)
        out.append(ids[at])
    return out


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _read(spark: SparkSession, path: str) -> str:
    """The vocabulary file, by any path that Spark can open or a local one of the driver."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenize(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Ids of every whole text, and the text decoded from them.

    Columns: those of ``keep``, ``ids`` (array<int>), ``decoded``. With ``digests`` instead of the
    latter two: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit numbers)
    and ``decoded_sha256`` (of the decoded text in UTF-8), so that ids do not leave the task.
    A null text is taken as empty: no ids, an empty text. Special tokens' strings in a text become
    their ids, as in the tokenizers library. Rows are kept one by one; the vocabulary, of fixed
    size, is sent to the tasks. Names in ``keep`` may not be those of the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_read(docs.sparkSession, vocabulary_path))
    given = docs.select(docs[text_col].cast("binary").alias("_text"), *(docs[c] for c in keep))
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for texts, rest in _with_rest(batches):
            out = encode(texts, vocabulary)
            if digests:
                columns = [
                    pa.array([len(x) for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in out]),
                    pa.array([hashlib.sha256(decode(x, vocabulary).encode()).hexdigest() for x in out]),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32())), pa.array([decode(x, vocabulary) for x in out])]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*columns, *rest.columns], names=[*names, *rest.schema.names])

    return given.mapInArrow(run, made + kept).select(*keep, *[c.split()[0] for c in made.split(", ")])


def _with_rest(batches: Iterator[pa.RecordBatch]):
    """Texts and a batch of the other columns, for about PART bytes of text at a time."""
    texts, rest, held = [], [], 0

    def joined():
        table = pa.Table.from_batches(rest).combine_chunks()
        return table.to_batches()[0]

    for batch in batches:
        begin = 0
        column, other = batch.column(0), batch.select(range(1, batch.num_columns))
        for k, text in enumerate(column):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            texts.append(raw.decode("utf-8", "replace"))
            held += len(raw)
            if held >= PART:
                rest.append(other.slice(begin, k + 1 - begin))
                yield texts, joined()
                texts, rest, held, begin = [], [], 0, k + 1
        if begin < batch.num_rows:
            rest.append(other.slice(begin))
    if texts:
        yield texts, joined()
