"""What Python workers hold at once in the pipeline's stages."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, packing
from tests.llm.test_pipeline import SF, stages


def largest_batch(df) -> int:
    """Bytes of the largest batch that a worker gets of df."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches], pa.int64())], ["n"])

    return max(r.n for r in df.mapInArrow(run, "n long").collect())


@pytest.mark.parametrize("k", range(1, 5))
def test_stages_bound_batches_by_bytes(spark, k):
    """30 MB of texts in one partition, fewer than the 10,000 rows of a batch."""
    long = spark.range(600, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat_ws(" ", F.lit("some words"), "id"), 4000).alias("text"),
        F.lit("en").alias("lang"), F.lit("a.org").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    spark.conf.unset(common.BATCH_SETTING)
    try:
        assert largest_batch(long) > 4 * common.BATCH_BYTES
        stages()[k][1](spark, long.where("doc_id < 3"), SF)
        assert largest_batch(long) < 2 * common.BATCH_BYTES
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_smaller_batch_setting_stays(spark):
    spark.conf.set(common.BATCH_SETTING, "1000")
    try:
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) == "1000"
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_tokens_forget_rare_words_only(monkeypatch):
    """Frequent words are encoded once, ids stay the library's, and the cache stays bounded."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    tokens = packing.Tokens(packing.tokenizer_path())
    encoded = []
    word = tokens.known.encode
    tokens.known.encode = lambda w: encoded.append(w) or word(w)
    for k in range(40):
        text = "often seen " + " ".join(f"rare{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + k // 26)}" for j in range(26))
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert tokens(text) == packing.Tokens._bytes(want)
        assert len(tokens.known) + len(tokens.known.old) < 300
    assert encoded.count("often") == encoded.count("seen") == 1
