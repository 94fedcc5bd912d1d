"""N-gram Jaccard join by pigeonhole over a partitioned universe.

Two shingle sets of sizes s and t with Jaccard similarity of at least J differ in at most
H(s, t) = s + t - 2 ceil(J (s + t) / (1 + J)) shingles. The universe of shingles is hashed into
segments, their number fixed for each band of sizes. Every segment gets a weight v: a segment of
weight 1 catches pairs that agree on it, one of weight 2 also pairs of which one side has a single
shingle more (its one-deletion neighbourhood). If the weights add up to more than H, some segment
catches the pair (Deng, Li, Wen and Feng, VLDB 2015). A set is indexed under its own band and
probes its own and the next smaller band, so the larger set of a pair looks for the smaller one.
H is not monotone, as it keeps the parity of s + t: a set takes the largest H of all its partners.

Costs decide twice. Each band chooses how many segments of weight 1 and 2 it has, and how many
units more than needed, from the keys they emit and the expected number of segments too small to
tell sets apart. Each set then probes only the fullest segments whose weights add up to more than
its own H; a segment with few shingles has the longest list.

Candidates that sizes and parity bits leave possible are verified exactly on whole sets. A set has
about eight times as many parity bits as linked sets may differ in shingles, so nearly all that is left
is linked. Groups are never expanded into all pairs: first every key links its members to one
leader; then, for keys whose members still lie in different components, members are sorted by size and
compared across components, as far as sizes allow, where they lie; only possible pairs leave the task.
Members of a key beyond BLOCK are dealt into blocks that meet pair by pair. Pairs already connected
need no test.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, spread, store
from .words import U64, mix, shingle_sets

#: Rows of one key within a chunk above which the key is salted.
HOT = 64
SALTS = 64
#: Members of a key that are compared in one place; more are dealt into blocks of about so many.
BLOCK = 4096
#: Parity bits for each shingle that linked sets may differ in, and the fewest and most of a set.
BITS_PER_DIFFERENCE, LEAST_BITS, MOST_BITS = 8, 256, 1 << 16

# Bits of a key row: the side of the index, the probing side, a one-deletion key, salted.
INDEX, PROBE, DELETED, SALTED = 1, 2, 4, 8
_ROW = pa.schema(
    [("kind", pa.int8()), ("key", pa.int64()), ("flag", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("bits", pa.list_(pa.int64()))]
)
_ROW_DDL = "kind tinyint, key bigint, flag tinyint, a bigint, b bigint, bits array<bigint>"
DOC, COPY, EDGE, GROUP = 0, 1, 2, 3


def most_different(s, t, num: int, den: int):
    """The largest symmetric difference of linked sets of sizes s and t, for J = num / den."""
    return s + t - 2 * (-(-num * (s + t) // (num + den)))


def _budget(s, low, high, num: int, den: int):
    """One more than the largest difference of sets of size s and linked ones of low to min(s, high).

    The difference keeps the parity of s + t and grows with t only within a parity, so the largest
    partner and the one a shingle smaller are looked at, if the latter is in reach.
    """
    top = np.minimum(s, high)
    less = (top - 1 >= low) & (den * (top - 1) >= num * s)
    return 1 + np.maximum(most_different(s, top, num, den), np.where(less, most_different(s, top - 1, num, den), 0))


@functools.cache
def bands(up_to: int, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Lower and upper size of each band, its segments, and how many of them have weight 2."""
    low, rows = 1, []
    while low <= up_to:
        high = low * den // num
        need = int(_budget(np.arange(low, high * den // num + 1), low, high, num, den).max())
        rows.append((low, high, *_allocate(low, need)))
        low = high + 1
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True))


def _allocate(size: int, need: int) -> tuple[int, int]:
    """(segments, those of weight 2) of least cost for sets of the size whose weights must reach need."""
    step = max(1, need // 64)
    slack = np.arange(0, need // 4 + 1, step)[:, None]
    twos = np.arange(0, (need + slack.max()) // 2 + 1, step)[None, :]
    ones = need + slack - 2 * twos
    m = np.maximum(ones + twos, 1)
    t = size / m
    weak = m * np.exp(-t) * (1 + t)  # segments with one shingle or none
    cost = ones + twos * (1 + t) + 12 * np.maximum(0, weak - slack) + m * np.exp(-t) * t * t
    at = np.unravel_index(np.argmin(np.where(ones >= 0, cost, np.inf)), cost.shape)
    return int(m[at]), int(twos[0, at[1]])


def _keys(tokens: np.ndarray, sizes: np.ndarray, ids: np.ndarray, num: int, den: int):
    """Key, flag and id of every segment key that the sets emit, under both bands of each set."""
    lows, highs, segments, twos = bands(int(sizes.max()), num, den)
    own = np.searchsorted(lows, sizes, side="right") - 1
    out = []
    for role in (INDEX | PROBE, PROBE):
        band = own if role & INDEX else own - 1
        # A set too large for anything in the smaller band needs no probe there.
        live = (band >= 0) & (num * sizes <= den * highs[np.maximum(band, 0)])
        if not live.any():
            continue
        d = np.flatnonzero(live)
        s, band, m = sizes[d], band[d], segments[band[d]]
        need = _budget(s, lows[band], highs[band], num, den)
        base = np.cumsum(m) - m
        total = int(m.sum())
        keep = np.repeat(live, sizes)
        tok = tokens[keep]
        of = np.repeat(np.arange(len(d)), s)
        salt = mix(band.astype(U64) + U64(77))
        code = base[of] + (mix(tok ^ salt[of]) % m[of].astype(U64)).astype(np.int64)
        count = np.bincount(code, minlength=total)
        half = U64(0xFFFFFFFF)
        low = np.bincount(code, weights=(tok & half).astype(np.float64), minlength=total).astype(U64)
        high = np.bincount(code, weights=(tok >> U64(32)).astype(np.float64), minlength=total).astype(U64)
        sums = low + (high << U64(32))
        doc = np.repeat(np.arange(len(d)), m)
        segment = np.arange(total) - base[doc]
        weight = 1 + (segment < twos[band[doc]])
        name = mix(salt[doc] + segment.astype(U64))
        # The fullest segments are probed until their weights reach what the set needs.
        order = np.lexsort((-count, doc))
        run = np.cumsum(weight[order])
        before = run - weight[order] - np.repeat((run[base] - weight[order][base]), m)
        probing = np.empty(total, bool)
        probing[order] = before < need[doc]
        flag = np.where(probing, role, role & INDEX).astype(np.int8)
        shown = flag > 0
        out.append((mix(sums ^ name)[shown], flag[shown], ids[d][doc[shown]]))
        cut = (weight[code] == 2) & (flag[code] > 0)
        if cut.any():
            c = code[cut]
            out.append((mix((sums[c] - tok[cut]) ^ name[c]), flag[c] | DELETED, ids[d][doc[c]]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64)
    key, flag, node = (np.concatenate(x) for x in zip(*out, strict=True))
    return key.view(np.int64), flag, node


def _rows(kind, key, flag, a, b, bits=None) -> pa.RecordBatch:
    n = len(a)
    bits = pa.nulls(n, _ROW.field("bits").type) if bits is None else bits
    full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else x.astype(t, copy=False)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(full(x, f.type.to_pandas_dtype())) for x, f in zip((kind, key, flag, a, b), _ROW, strict=False)), bits],
        schema=_ROW,
    )


def _bits_of(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many parity bits sets of these sizes have: a power of 2."""
    differ = np.maximum(most_different(sizes, sizes * den // num, num, den), 1) * BITS_PER_DIFFERENCE
    return np.clip(1 << np.ceil(np.log2(differ)).astype(np.int64), LEAST_BITS, MOST_BITS)


def _parity(tokens: np.ndarray, sizes: np.ndarray, num: int, den: int) -> pa.Array:
    """Bits of each set: each is the parity of the tokens that fall on it.

    A token that only one of two sets has turns one bit, so the sets differ in at least as many
    tokens as their bits differ. Halves of a longer vector, xored, give the shorter one.
    """
    bits = _bits_of(sizes, num, den)
    begin = np.cumsum(bits) - bits
    place = np.repeat(begin, sizes) + (tokens >> U64(32)).astype(np.int64) % np.repeat(bits, sizes)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(bits // 64)], pa.int32()), pa.array(words))


def _differing(words: np.ndarray, begin: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the vectors of rows x and y differ, on the length of the shorter one."""
    out = np.zeros(len(x), np.int64)
    la, lb = length[x], length[y]
    for both in np.unique(la << 32 | lb).tolist():
        at = np.flatnonzero((la << 32 | lb) == both)
        m, n = both >> 32, both & 0xFFFFFFFF
        least = min(m, n)
        for part in np.array_split(at, max(1, len(at) * max(m, n) >> 21)):
            a, b = (
                np.bitwise_xor.reduce(words[begin[rows[part]][:, None] + np.arange(k)].reshape(len(part), k // least, least), axis=1)
                for rows, k in ((x, m), (y, n))
            )
            out[part] = np.bitwise_count((a ^ b).view(U64)).sum(axis=1)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all lists, and where each begins and how long it is."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(), offsets[:-1], np.diff(offsets)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 8 << 20):
    """Lists of (id, text) of about so many bytes; rows without id or text are left to the caller."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(i)
            texts.append(raw)
            held += len(raw)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _emit(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches):
        tokens, sizes = shingle_sets(texts, n)
        given = np.array([i is not None for i in ids])
        node = np.array([i if i is not None else 0 for i in ids], np.int64)
        if given.any():  # spread by a hash of the id
            bits = _parity(tokens[np.repeat(given, sizes)], sizes[given], num, den)
            yield _rows(DOC, mix(node[given].view(U64)).view(np.int64), 0, node[given], sizes[given], bits)
        # Copies within the chunk stand behind the first of them.
        ends = np.cumsum(sizes)
        first: dict[bytes, int] = {}
        kept, copies = np.zeros(len(ids), bool), []
        for i in np.flatnonzero(given & (sizes > 0)):
            whole = tokens[ends[i] - sizes[i] : ends[i]].tobytes()
            leader = first.setdefault(whole, node[i])
            if leader == node[i] and not kept[i]:
                kept[i] = True
            else:
                copies.append((leader, node[i]))
        del first
        if copies:
            c = np.array(copies, np.int64)
            yield _rows(COPY, mix(c[:, 1].view(U64)).view(np.int64), 0, c[:, 0], c[:, 1])
        if not kept.any():
            continue
        key, flag, at = _keys(tokens[np.repeat(kept, sizes)], sizes[kept], node[kept], num, den)
        order = np.lexsort((flag == INDEX, flag & DELETED, key))
        key, flag, at = key[order], flag[order], at[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        length = np.diff(np.r_[start, len(key)])
        leader = np.repeat(start, length)
        hot = (np.repeat(length, length) > HOT) & (leader != np.arange(len(key)))
        flag = np.where(hot, flag | SALTED, flag).astype(np.int8)
        if hot.any():
            e = hot & _meets(flag[leader], flag) & (at[leader] != at)
            yield from _pairs(at[leader][e], at[e])
        yield _rows(GROUP, key, flag, at, 0)


def _meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of one key with these flags are a candidate pair."""
    plain = ((x & DELETED) == 0) | ((y & DELETED) == 0)
    return plain & ((((x & INDEX) > 0) & ((y & PROBE) > 0)) | (((x & PROBE) > 0) & ((y & INDEX) > 0)))


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield _rows(EDGE, mix(pair[:, 1].view(U64)).view(np.int64), 0, pair[:, 0], pair[:, 1])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: passes on rows of groups that can hold a link, and leader edges.

    Of a group that runs over the end of a batch only the leader (and a first lone row) is kept,
    so that a group of any size needs no memory.
    """
    lead = None  # key, flag, node of the group that the last batch ended in; whether its first row is out
    for batch in batches:
        kind, key, flag, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        other = kind != GROUP
        if other.any():
            bits = batch.column(5).filter(pa.array(other))
            yield _rows(kind[other], key[other], flag[other], a[other], b[other], bits)
            key, flag, a = key[~other], flag[~other], a[~other]
        if not len(key):
            continue
        if lead is not None and not lead[3]:
            key, flag, a = np.r_[lead[0], key], np.r_[lead[1], flag].astype(np.int8), np.r_[lead[2], a]
            lead = None
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        of = np.repeat(np.arange(len(start)), length)
        lk, lf, ln = key[start].copy(), flag[start].copy(), a[start].copy()
        many = (length > 1) | ((lf & SALTED) > 0)
        if lead is not None and lead[0] == key[0]:
            lf[0], ln[0], many[0] = lead[1], lead[2], True
        last_alone = not many[-1]
        out = many[of]
        if out.any():
            e = out & (ln[of] != a) & _meets(lf[of], flag)
            yield from _pairs(ln[of][e], a[e])
            yield _rows(GROUP, key[out], flag[out], a[out], 0)
        lead = (lk[-1], lf[-1], ln[-1], not last_alone)


def _verify(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b): those whose whole sets reach the similarity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        ids = np.unique(np.r_[a, b])
        place = {i: k for k, i in enumerate(ids.tolist())}
        texts: list = [b""] * len(ids)
        for column, node in ((batch.column(2), a), (batch.column(3), b)):
            for text, i in zip(column, node.tolist(), strict=True):
                k = place[i]
                if not texts[k] and text.is_valid:
                    texts[k] = text.as_buffer().to_pybytes()
        tokens, sizes = shingle_sets(texts, n)
        sets = np.split(tokens, np.cumsum(sizes)[:-1])
        good = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sets[place[i]], sets[place[j]]
            if len(x) > len(y):
                x, y = y, x
            if not len(x) or den * len(x) < num * len(y):
                good.append(False)
                continue
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            good.append(den * common >= num * (len(x) + len(y) - common))
        mask = np.array(good)
        yield pa.RecordBatch.from_arrays([pa.array(a[mask]), pa.array(b[mask])], names=["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(lambda it: _verify(it, n, num, den), "a bigint, b bigint")


def _texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts that occur in pairs, stored; the ids are stored first, so that Spark knows their size."""
    node = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    return store(docs.join(node, "node", "left_semi"), "texts")


def _possible(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, size, size2, bits, bits2) those that sizes and parity bits leave possible."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, s, t = (batch.column(k).to_numpy() for k in range(4))
        words, begin, length = _lists(pa.concat_arrays([batch.column(4), batch.column(5)]))
        near = np.flatnonzero(den * np.minimum(s, t) >= num * np.maximum(s, t))
        differ = _differing(words, begin, length, near, near + len(a))
        near = near[differ <= most_different(s, t, num, den)[near]]
        yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Possible pairs across components among the members of each key and pair of blocks.

    Rows (key, i, j, own, size, node, component, flag, bits), sorted by key, i, j and size: each is
    held against the next one, the next but one and so on, until sizes lie too far apart.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_batches([held, batch]) if held is not None else batch
        key, i, j = (held.column(k).to_numpy() for k in range(3))
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        if not len(new):
            continue  # one group, of two blocks at most
        yield from _compared(held.slice(0, int(new[-1])), num, den)
        held = held.slice(int(new[-1]))
    if held is not None:
        yield from _compared(held, num, den)


def _compared(rows: pa.RecordBatch, num: int, den: int) -> Iterator[pa.RecordBatch]:
    key, i, j, own, size, node, component, flag = (rows.column(k).to_numpy() for k in range(8))
    words, begin, length = _lists(rows.column(8))
    n, lag, live = len(key), 1, np.arange(len(key))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live := live[live + lag < n]):
        other = live + lag
        same = (key[live] == key[other]) & (i[live] == i[other]) & (j[live] == j[other])
        same &= den * size[live] >= num * size[other]
        live, other = live[same], other[same]
        meet = (component[live] != component[other]) & _meets(flag[live], flag[other])
        meet &= (i[live] == j[live]) | (own[live] != own[other])
        x, y = live[meet], other[meet]
        possible = _differing(words, begin, length, x, y) <= most_different(size[x], size[y], num, den)
        x, y = x[possible], y[possible]
        if len(x):
            found.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y])))
        lag += 1
    if found:
        pair = np.unique(np.stack([np.concatenate(z) for z in zip(*found, strict=True)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5
) -> DataFrame:
    """Links texts whose sets of n-word shingles have a Jaccard similarity of at least num / den.

    One row for each document: ``doc_id``, ``n_shingles`` (set size), ``component_id`` (smallest id
    reachable by links, itself included). Words are runs outside ASCII white space, A-Z
    lower-cased; a text with fewer than n words is one shingle; null and blank texts have none and
    link with nothing. Rows with a null id are returned with their set size and a null component;
    rows that repeat an id are returned each, and any of their texts can link it. Other columns of
    the input are not read. An empty table gives no rows.
    """
    given = docs.select(docs[id_col].cast("bigint").alias("node"), docs[text_col].alias("text"))
    ddl = _ROW_DDL
    place = F.xxhash64("key", F.when(F.col("flag").bitwiseAND(SALTED) > 0, F.pmod("a", F.lit(SALTS))))
    binary = given.select("node", F.col("text").cast("binary").alias("text"))
    found = store(
        binary.mapInArrow(lambda it: _emit(it, n, num, den), ddl)
        .repartition(place)
        .sortWithinPartitions("key", F.col("flag").bitwiseAND(DELETED), F.col("flag").bitwiseAND(3) == INDEX, "a")
        .mapInArrow(_gather, ddl),
        "segments",
        by="kind",
    )
    groups = found.where(F.col("kind") == GROUP).select("key", "flag", F.col("a").alias("node"))
    copies = found.where(F.col("kind") == COPY).select("a", "b")
    bits = found.where((F.col("kind") == DOC) & (F.col("b") > 0)).select(F.col("a").alias("node"), F.col("b").alias("size"), "bits")
    one = bits.withColumnRenamed("node", "a")
    two = bits.select(F.col("node").alias("b"), F.col("size").alias("size2"), F.col("bits").alias("bits2"))
    edges = found.where(F.col("kind") == EDGE).select("a", "b").distinct()
    sized = edges.join(one, "a").join(two, "b").select("a", "b", "size", "size2", "bits", "bits2")
    pairs = store(sized.mapInArrow(lambda it: _possible(it, num, den), "a bigint, b bigint").distinct(), "pairs")
    texts = _texts_of(pairs, binary)
    links = store(_linked(pairs, texts, n, num, den), "links")
    edges = copies.union(links)
    labels = connected_components(edges, "a", "b")
    labels = _across(groups, labels, edges, pairs, bits, binary, (n, num, den))
    rows = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    known = rows.join(spread(labels), rows.doc_id == labels.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    nameless = binary.where("node is null").mapInArrow(lambda it: _sizes(it, n), "n_shingles bigint")
    null = F.lit(None).cast("bigint")
    return known.union(nameless.select(null.alias("doc_id"), "n_shingles", null.alias("component_id")))


def _sizes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for _, texts in _chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts, n)[1])], names=["n_shingles"])


def _across(groups, labels, edges, tested, bits, docs, rule) -> DataFrame:
    """Labels after all possible pairs across components are tested; see the module's text."""
    _, num, den = rule
    named = groups.join(spread(labels), "node", "left").select("key", "flag", "node", F.coalesce("component", "node").alias("component"))
    named = store(named, "named")
    ends = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    mixed = store(ends.where("x <> y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    if mixed.isEmpty():
        return labels
    rows = named.join(mixed, "key").join(bits, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "size", "node", "component", "flag", "bits")
    order = ["key", "i", "j"]
    met = placed.repartition(F.xxhash64(*order)).sortWithinPartitions(*order, "size").mapInArrow(lambda it: _compare(it, num, den), "a bigint, b bigint")
    pair = store(met.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    links = store(_linked(pair, _texts_of(pair, docs), *rule), "links")
    return labels if links.isEmpty() else connected_components(edges.union(links), "a", "b")
