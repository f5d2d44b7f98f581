import pytest

from graspmeter.llm.common import prepared

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, id long"


@pytest.fixture(autouse=True)
def _workers(spark):
    prepared(spark)


@pytest.fixture
def docs(spark):
    """Documents from ``(id, text)`` or ``(id, text, source)``, with extra columns of clashing names."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 0.5, 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
