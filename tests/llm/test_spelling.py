"""Spelling variants against all pairs, counted words against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from driftgauge.llm import spelling
from driftgauge.session import ship


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(near))
    rows = set()
    for w, (form, n, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, m, words[form] if form else None))
    return rows


def counted(rows):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= 5
    return {w: n for w, n in c.items() if n >= 3}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("pairs", [1 << 14, 30, 1])
def test_all_pairs(spark, pairs):
    rng = random.Random(pairs)
    words = {"".join(rng.choice("abé×") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 60) for _ in range(700)}
    words |= {"x" * n: n for n in range(5, 40)} | {"long" * 300: 9, "long" * 300 + "s": 3, "lång" + "long" * 299: 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(df, pairs=pairs).collect()
    assert len(got) == len(words) and rows_of(spelling.variants(df, pairs=pairs)) == plain(words)
    assert sum(r.n_near for r in got) > 500 and len({r.root for r in got if r.form}) > 3


def test_op12(spark, sf):
    ship(spark)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(spelling.op12_spelling(spark, sf)) == plain(counted(docs))


def test_awkward_texts(spark):
    ship(spark)
    long = " ".join(["Straße"] * 5 + ["naïve"] * 4 + ["naive"] * 12) + " " + "z" * 2_000_000 + " " + "wordy " * 300_000
    rows = [(1, None, 0), (2, "", 0), (None, "Äpfel ÄPFEL äpfel Äpfel. 12 _ ÷÷÷÷÷", 0), (None, "Äpfel ÄPFEL äpfel Äpfel. 12 _ ÷÷÷÷÷", 0), (3, long, 0), (3, long, 0), (4, "abcde" * 3, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.word: r.n for r in spelling.count_words(df, fault=97).collect()}
    assert got == counted([(i, t) for i, t, _ in rows]) and got["wordy"] == 600_000
    assert spelling.count_words(df).where("word = 'straße'").first().n == 10
    assert spelling.variants(spelling.count_words(df.where("false"))).count() == 0


def test_parts_never_cut_a_run():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aaé .\n") for _ in range(rng.randrange(80)))
        got = list(spelling.parts(text, 7))
        assert "".join(got) == text and all(len(x) for x in got)
        assert sum((Counter(re.findall("[aé]+", x)) for x in got), Counter()) == Counter(re.findall("[aé]+", text))


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(spelling.ORACLE_SQL).fetchall()
    ship(spark)
    assert rows_of(spelling.op12_spelling(spark, sf)) == set(want)
