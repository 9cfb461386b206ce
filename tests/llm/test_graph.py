"""Components over many rounds: right, and without sizes that multiply in the planner."""

from driftgauge.llm import jaccard
from driftgauge.llm.graph import components
from driftgauge.session import ship


def digits(df) -> int:
    """Bits of the size that the planner supposes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_rounds_over_a_path_do_not_multiply_sizes(spark):
    ship(spark)
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(8, "a")
    got = components(edges)
    assert digits(got) < 100
    assert {r.node: r.component for r in got.collect()} == dict.fromkeys(range(n + 1), 0)


def test_a_chain_of_versions_in_one_large_block(spark):
    ship(spark)
    chain = [(i, " ".join(f"v{j}" for j in range(i, i + 40))) for i in range(80)]
    apart = [(1000 + 2 * i + j, " ".join([f"q{i}x{k}" for k in range(8)] + [f"same{k}" for k in range(32)])) for i in range(30) for j in (0, 1)]
    got = jaccard.join(spark.createDataFrame(chain + apart, "doc_id long, text string").repartition(8), block=20)
    assert digits(got) < 1000
    want = {i: 0 for i, _ in chain} | {i: i - i % 2 for i, _ in apart}
    assert {r.doc_id: r.component_id for r in got.collect()} == want
