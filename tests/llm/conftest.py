import datetime

import pytest

TEXTS = {
    1: "The quick brown fox jumps over the lazy dog. " * 3,
    2: "The quick brown fox jumps over the lazy dog. " * 3,
    3: None,
    4: "",
    5: "Wholly other words stand here, one after another,\nand all rights reserved by nobody in particular.",
    6: "x" * 50_000 + " y " * 20_000,
    7: "you stupid idiot " * 4,
    8: " \t\n ",
}


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, long texts, copies, repeated rows, a null id, and columns with clashing names."""
    rows = [(k, t, "en", None if k == 5 else "s", len(t or ""), 9.9, "mine", datetime.date(2024, 1, 1)) for k, t in TEXTS.items()]
    rows += [rows[0], (None, "no id at all in this row", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, shard string, hash date")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)
