"""Tables of odd rows for all operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, key string, shard string"

ODD = ["", None, " ", "  a  b", "a   b\n  c \n\n d\t e  ", "it's  'll ", "ü  é  x", "<|endoftext|> a", "x <|endoftext|> y", "a.<|endoftext|><|endoftext|>b  <|endoftext|>\n <|endoftext", "日本 語  語", "don't. a.b. é, ab.,; 12, x1."]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, "plain words here. All rights reserved, all RIGHTS reserved", "en", "a", 3),
        (1, "plain words here. All rights reserved, all RIGHTS reserved", "en", "a", 3),
        (2, None, None, None, None),
        (None, "text without an id", "en", None, 1),
        (None, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, passage, "en", "b", 9),
        (5, "word " * 60_000 + passage, "en", "b", 9),
        (6, "Licensed under the Apache License, Version 2.0.\nRest of it.", "en", "c", 1),
        (7, "ÉTÉ Été cc-by CC byé cc by", "fr", "c", 1),
        *[(10 + i, t, "en", "d", 1) for i, t in enumerate(ODD)],
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", "s") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
