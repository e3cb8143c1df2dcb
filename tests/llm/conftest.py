import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, score double, kept string"

    def make(rows):
        full = [(*r, *(["s"] if len(r) == 2 else [])) for r in rows]
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", 1, 0.5, "k") for d, t, s in full], T._parse_datatype_string(schema))

    return make
