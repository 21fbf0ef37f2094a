import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    common = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, common, "en", "a"), (2, common, "en", "a"), (3, common + " x", None, None), (4, None, "en", "a"), (5, "", "de", ""),
        (6, " \t\n ", "en", "b"), (7, "word", "en", "b"), (8, "word", "en", "b"), (9, "le café coûte 3 €  漢字 " * 20000, "fr", "b"),
        (10, "mail me: jo.doe+x@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (663) 555-6869 now", "en", "a"),
        (10, "mail me: jo.doe+x@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (663) 555-6869 now", "en", "a"),
        (11, "0" * 30000 + " " + "a" * 30000 + "@", "en", "c"), (12, "a@b.c" * 3 + " 1.2.3.4.5.6.7.8 " + "1 " * 9000, "en", "c"), (None, common, "en", "a"),
        (None, None, None, None), (13, "Licensed under the Apache License, Version 2.0.\nmore text here", "en", "d"), (14, "Ünïcode!! " * 50, "xx", "d"),
    ]
    wide = [(*r, None, k, f"s{k}", k % 2, 0.5, [k], "z") for k, r in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, accepted int, quality_score double, spans array<long>, `a.b` string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
