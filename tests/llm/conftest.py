import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with the other columns and some that clash with internal names."""
    def make(pairs, **options):
        rows = [(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        for name in ("score", "name", "bands", "key", "n", "lines", "component_id", "text_hash", "print", "turn"):
            df = df.selectExpr("*", f"'x' as {name}")
        return df.repartition(options.get("parts", 3))
    return make


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
