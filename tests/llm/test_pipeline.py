"""The pipeline's stages keep what they should, and agree with plain forms of them."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from driftgauge.llm import bpe, mixing, secrets, toxicity
from driftgauge.session import ship


def test_stages(spark, sf):
    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = {r.doc_id: r.score for r in toxicity.classify(docs, toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    kept = {r.doc_id: r for r in docs.collect() if scored[r.doc_id] < 0.5}
    groups = brute.jaccard([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if groups[i][1] == i}
    masked = {i: secrets.mask(r.text, secrets.spans(r.text)[1]) for i, r in kept.items()}
    df = spark.createDataFrame([(i, masked[i], r.lang, r.source, len(masked[i])) for i, r in kept.items()], docs.schema)
    drawn = {r.doc_id for r in mixing.weigh(df).where("mix.kept").select("doc_id").collect()}
    b = bpe.load(bpe.default_path())
    want = {i: b.encode([masked[i]])[0].tolist() for i in drawn}
    got = {r.doc_id: r.input_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 20


def test_awkward_rows_pass_through(spark, sf):
    ship(spark)
    rows = [(1, None, None, None, None, 7), (None, "", None, "s", 0, 7), (3, "plain words here", "en", None, 16, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id"]
    assert docs.count() == 3
    assert corpus_pipeline.STAGES[3][1](spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.encode_ids(spark, docs.where(F.lit(False)), sf).count() == 0


def test_one_of_each_group_with_null_and_repeated_ids(spark, sf):
    ship(spark)
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(None, one), (None, one), (4, one), (7, two), (7, two), (9, two), (5, three), (5, "text of its own under the id of another one"), (2, three), (None, "null id and text of its own in this row"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf)
    want = [(None, one), (7, two), (5, rows[7][1]), (2, three), rows[9], (8, None), (8, None)]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_encoding_decodes_its_ids(spark, sf):
    ship(spark)
    rows = [(1, "plain words, here\n\n", "en"), (2, None, "en"), (3, "", "en"), (4, "naïve 日本語 🙂 \u0000 <|endoftext|> x", "de"), (1, "plain words, here\n\n", "en")]
    got = corpus_pipeline.encode_ids(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), sf).collect()
    assert sorted((r.doc_id, r.decoded) for r in got) == sorted((i, t or "") for i, t, _ in rows)
    b = bpe.load(bpe.default_path())
    assert all(r.n_tokens == len(r.input_ids) and r.decoded == b.decode(b.encode([dict((i, t) for i, t, _ in rows)[r.doc_id]])[0]) for r in got)
