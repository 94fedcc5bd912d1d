"""The pipeline's stages over a small folder, against what plain Python expects."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    say = lambda n: " ".join("".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(n))
    clean = {k: say(120) for k in range(0, 160, 2)}
    spam = {k: "BUY!! " * (10 + k) for k in range(1, 160, 2)}
    passage, item, own = say(90), say(14), [say(100) for _ in range(4)]
    planted = {
        500: clean[0],
        502: f"{own[0]} {passage}",
        504: f"{own[1]} {passage} {own[2]}",
        506: f"{own[3]} {item} {say(90)}",
    }
    texts = {**clean, **spam, **planted}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), "more") for k, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.range(160).select(F.col("id").alias("doc_id"), ((F.col("id") + 1) % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicates", "repeated_passages", "decontaminated", "tokens"]
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*clean, 502, 504, 506}
    assert all(got[k] == texts[k] for k in [*clean, 502])
    left = got[504].split()
    assert got[504].startswith(own[1]) and got[504].endswith(own[2])
    assert 200 <= len(left) <= 230
    assert item not in got[506] and re.sub(r"\s+", " ", got[506]) == re.sub(r"\s+", " ", texts[506].replace(item, ""))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_decides_row_by_row(spark, tmp_path):
    """Ids that are null or stand on several rows, with equal and with different texts."""
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    say = lambda n: " ".join("".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(n))
    clean = {k: say(120) for k in range(0, 160, 2)}
    spam = {k: "BUY!! " * (10 + k) for k in range(1, 160, 2)}
    copied, other, third, item = say(110), say(115), say(130), say(14)
    odd = [(None, copied), (None, copied), (900, copied), (900, copied), (901, other), (901, third), (None, f"{say(60)} {item} {say(60)}"), (902, f"{item} {say(90)}"), (902, "BUY!! " * 40), (None, "BUY!! " * 50), (None, None)]
    rows = [(k, t) for k, t in [*clean.items(), *spam.items(), *odd]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.range(160).select(F.col("id").alias("doc_id"), ((F.col("id") + 1) % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(t == copied for _, t in got) == 1
    assert (901, other) in got and (901, third) in got
    assert not any("BUY" in t or item in t for _, t in got)
    assert all((k, t) in got for k, t in clean.items())
    assert sorted(str(k) for k, t in got if k not in clean and t != copied) == ["901", "901", "902", "None"]
