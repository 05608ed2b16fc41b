import os

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.tokens import VOCABULARY, encoding, sized, token_count

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_counts_and_round_trip(spark):
    texts = ["Hello world, it's 2024!", "", None, "  spaces   ", "длинный текст", "x" * 20_000, "<|endoftext|>"]
    e = encoding(VOCABULARY)
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count("t").alias("n")).collect()]
    assert got == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    for t in filter(None, texts):
        assert e.decode(e.encode_ordinary(t)) == t


def test_sized_keeps_asked_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9)], "doc_id bigint, text string, source string, tokens bigint")
    assert sized(df, "doc_id", "text", source=F.col("source")).collect()[0].asDict() == {"doc_id": 1, "source": "s", "tokens": 2}
