import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of a list of (doc_id, text); lengths follow the texts."""

    def make(rows, extra=()):
        full = [(i, t, "en", "s", len(t) if t is not None else None, *(1.5 for _ in extra)) for i, t in rows]
        return spark.createDataFrame(full, ", ".join([DOCUMENT, *(f"{n} double" for n in extra)]))

    return make


@pytest.fixture(scope="session")
def saved(spark, tmp_path_factory):
    """Folder of tables as the queries read them."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
