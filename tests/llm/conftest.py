from __future__ import annotations

import pytest


@pytest.fixture
def table(spark):
    """Rows (doc_id, text) as a table with columns whose names may clash with an operator's own."""

    def make(rows, **more):
        columns = {"source": "string", "lang": "string", "size": "string", "n_words": "string", "id": "string", "n": "string", "key": "string"}
        schema = "doc_id bigint, text string, " + ", ".join(f"{c} {t}" for c, t in columns.items())
        data = [(d, t, *(more.get(c, lambda i: "x")(i) for c in columns)) for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(data, schema).repartition(3)

    return make
