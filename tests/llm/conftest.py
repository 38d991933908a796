import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, schema=DOCS):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] else None) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables and returns their folder."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
