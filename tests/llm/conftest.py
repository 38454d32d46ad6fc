import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, v string, keep_id string, copies string, place string, `all` string, sid string, m string, __row string, __id string, __sha string, __gone string, __least string, __source string, fill string"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "k", "z", "v", "x", "c", *"abcdefghijk") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "Same text here, twice."), (6, "Same text here, twice."), (None, "no id at all"), (None, None), (7, "é ü 你好 😀 \U0001f600 ok"), (7, "é ü 你好 😀 \U0001f600 ok"), (8, "long " * 60_000)]
