"""Helpers of the operators: intermediate tables, connected components, table access."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.sources.scratch import store


_SHIPPED = "tallyglass.shipped"


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, wherever the driver has loaded it from; once."""
    sc = spark.sparkContext
    if spark.conf.get(_SHIPPED, None) == sc.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="tallyglass-code-")) / "tallyglass.zip"
    with zipfile.ZipFile(to, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(to))
    spark.conf.set(_SHIPPED, sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by any path that Spark can open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels may not be learned from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly, so that a join shuffles both sides itself and Spark can split a hot key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Row numbers of rows whose id does not name them alone begin here.
OWN_ROWS = 1 << 62


def row_ids(docs: DataFrame, id_col: str, name: str = "_row") -> DataFrame:
    """The rows with a bigint column ``name`` that is never null and different for each row.

    It is the id on one row of each id. Rows with a null id, and the other rows of an id, get
    numbers above all ids, so that what goes by the order of ids takes them last. Only if there
    are such rows the table is numbered and stored. Runs a job that counts ids.
    """
    key = docs[id_col].cast("bigint")
    counted = docs.select(key.alias("_id")).groupBy("_id").agg(F.count("*").alias("n"))
    if counted.where(F.col("_id").isNull() | (F.col("n") > 1) | (F.col("_id") >= OWN_ROWS)).isEmpty():
        return docs.withColumn(name, key)
    numbered = store(docs.withColumn("_n", F.monotonically_increasing_id()).withColumn("_key", key), "rows")
    groups = numbered.where(F.col("_key") < OWN_ROWS).groupBy(F.col("_key").alias("_id")).agg(F.min("_n").alias("_first"), F.count("*").alias("_times"))
    firsts = store(groups.where("_times > 1").select("_id", "_first"), "odd_ids")
    marked = numbered.join(spread(firsts), numbered["_key"] == firsts["_id"], "left")
    own = F.col("_key").isNull() | (F.col("_key") >= OWN_ROWS) | (F.col("_first") != F.col("_n"))
    return marked.withColumn(name, F.when(own, F.col("_n") + OWN_ROWS).otherwise(F.col("_key"))).drop("_n", "_key", "_id", "_first")


def labelled_sample(labels: DataFrame, most: int, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label) of all learnable ids, or of at most ``most`` of them by a hash of the id.

    Held-out ids and null labels are left out. An id has a row for label 0, one for label 1, or
    both. Ids are taken in the order of their hash up to a cut that one count of hash classes finds,
    so neither the driver nor a task ever holds more than the classes and the sample.
    """
    doc_id = labels[id_col].cast("bigint").alias("doc_id")
    known = labels.select(doc_id, (labels[label_col].cast("double") > 0).cast("double").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).distinct()
    hashed = known.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    ids = hashed.select("doc_id", "_h").distinct()
    begin, taken = 0, 0
    for bits in (47, 31, 15):  # classes of a class that is too large alone are looked into
        here = ids.where((F.col("_h") >= begin) & (F.col("_h") <= begin + (1 << (bits + 16)) - 1))
        counts = {r.c: r.n for r in here.groupBy(F.shiftright(F.col("_h") - begin, bits).alias("c")).agg(F.count("*").alias("n")).collect()}
        for c in range(1 << 16):
            if taken + counts.get(c, 0) > most:
                break
            taken += counts.get(c, 0)
            begin += 1 << bits
        else:
            break
        if taken > most // 2:
            break
    return store(hashed.where(F.col("_h") < begin).drop("_h") if begin < 1 << 63 else known, "sample")


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) with v < u, sorted: joins every u, and its other neighbours, to its lowest one."""
    last, low = None, 0  # of the node that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = (c.to_numpy() for c in batch.columns)
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(u)]))
        m = v[start].copy()
        first = np.zeros(len(u), bool)
        first[start] = True
        if last is not None and last == u[0]:
            m[0], first[0] = low, False
        last, low = u[-1], m[-1]
        other = ~first & (v != m[of]) & np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[u[first], v[other]]), pa.array(np.r_[m[of[first]], m[of[other]]]),
             pa.array(np.r_[np.zeros(first.sum(), np.int8), np.ones(other.sum(), np.int8)])],
            names=["u", "v", "more"],
        )


def _roots_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as (node, smallest node that it reaches in the batch).

    A node stands at most once in u for each batch, whatever its number of edges, so a hub sends
    one row a batch to the shuffle.
    """
    for batch in batches:
        if batch.num_rows:
            nodes, at = np.unique(np.concatenate([c.to_numpy() for c in batch.columns]), return_inverse=True)
            a, b = at[: batch.num_rows], at[batch.num_rows :]
            root = np.arange(len(nodes))
            while (root[a] != root[b]).any():
                x, y = root[a], root[b]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
            low = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[root[low]])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge but the smallest.

    Each batch is contracted on its own first. Small-star steps (Kiveris et al., 2014) join each node's lower neighbours to the lowest of
    them until every node has one lower neighbour; then each node jumps to its parent's parent
    until all parents are roots. Groups are streamed, never held; rounds are written to the shared
    folder. Edges with a null end and loops are ignored; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("u"), F.least(x, y).alias("v")
    )
    while True:
        rows = now.mapInArrow(_roots_here, "u bigint, v bigint").repartition("u").sortWithinPartitions("u", "v").mapInArrow(_lowest, "u bigint, v bigint, more tinyint")
        rows = store(rows, "edges")
        now = rows.select("u", "v")
        if rows.where("more = 1").isEmpty():
            break
    while True:
        up = now.select(F.col("u").alias("v"), F.col("v").alias("w"))
        far = store(
            now.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("far")),
            "parents",
        )
        now = far.select("u", "v")
        if far.where("far").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
