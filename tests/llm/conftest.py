import pytest

KIND = "doc_id bigint, text string, lang string, fp string, kept string, spans string, stats string"


@pytest.fixture
def made(spark):
    """Documents with further columns whose names the operators use themselves."""

    def run(*rows):
        filled = [(i, t, "en", "fp", "kept", "spans", "stats") for i, t in rows]
        return spark.createDataFrame(filled, KIND)

    return run
