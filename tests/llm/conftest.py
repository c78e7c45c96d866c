import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


TEXTS = ["", None, "a", "it's  <|endoftext|> a 'test\n\n  x'll 12 3  ", " \n", "ΑΣ ΣΑ İx <|startoftext|>Y é ÀÉ", "word " * 3000, "word " * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, an empty and long texts, repeats, and columns with clashing names."""
    rows = [(i, t, "en", "s", 0, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None, None), (3, TEXTS[3], "en", "s", 0, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n_bytes string")
