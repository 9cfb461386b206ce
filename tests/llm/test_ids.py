"""Ids that are no integers, the least integer, and columns that clash."""

import numpy as np
import pytest

from driftgauge.llm import embeddings, jaccard, packing, scoring, substring, text, toxicity
from driftgauge.session import ship

LEAST = -(2**63)


def test_text_ids(spark):
    ship(spark)
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("1", long), ("x", long), (None, "some other words " * 9), ("7", "")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()} >= {(7, 7)} and jaccard.join(docs).count() == 4
    assert sorted(r.doc_id or 0 for r in substring.dedup(docs).collect()) == [0, 0, 1, 7]
    assert sorted(r.doc_id or 0 for r in scoring.score(docs).collect()) == [0, 0, 1, 7]
    assert sorted(d or 0 for r in packing.pack(docs).collect() for d in r.doc_ids) == [0, 0, 1, 7]
    vectors = spark.createDataFrame([("3", [1.0, 0.0]), ("y", [1.0, 0.1])], "vec_id string, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links) for r in embeddings.near_dups(vectors).collect()) == [(0, 1), (3, 1)]


def test_the_least_integer_is_null(spark):
    ship(spark)
    docs = spark.createDataFrame([(LEAST, "one two three four five six"), (2, "seven")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in substring.dedup(docs).collect()) == [0, 2]


def test_a_score_column_is_replaced(spark):
    df = spark.createDataFrame([(1, "words", "mine")], "doc_id long, text string, score string")
    out = toxicity.classify(df, toxicity.fit(["bad words here"] * 9 + ["good text"] * 9, np.array([1] * 9 + [0] * 9)))
    assert out.columns == ["doc_id", "text", "score"] and 0 <= out.first().score <= 1


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return Context

        @staticmethod
        def isEmpty():  # noqa: N802
            return True

    frame = type("Frame", (), {"sparkSession": type("Session", (), {"sparkContext": Context, "conf": Conf()})})
    with pytest.raises(ValueError, match="checkpoint.dir"):
        text.checkpoint(frame)
