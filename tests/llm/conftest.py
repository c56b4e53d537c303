import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def save(spark, tmp_path):
    """Writes tables to a folder as the queries read them."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


@pytest.fixture
def docs(spark, save):
    def make(texts, langs=None, sources=None, ids=None, **more):
        n = len(texts)
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        assert n == len(rows)
        return save(documents=df, **more)

    return make


@pytest.fixture
def awkward():
    """Null, empty, blank, repeated, very short and long texts."""
    return [None, "", "  \n ", "one", "one two three", "x " * 30_000, "same text here " * 9, "same text here " * 9, "É ß 中文 \x1c  end", "tab\tand\x0bfeed"]
