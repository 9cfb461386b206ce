"""Spelling variants by an even-partition pigeonhole join.

Words are counted over all texts. Of two words one edit apart, the shorter (of length l) is cut in its two even
segments, whose lengths depend on l alone: the edit lies in one of them, so the other stands unchanged in the
longer word, at its beginning or, shifted by the difference in length, at its end. Words index both segments of
their own; words of l or l + 1 code points probe with their beginning and end of these lengths. Segments meet in an
equi-join, candidates that more than one segment gives are counted once, and each is verified as one edit.

A segment that very many words share (its pairs would be more than PAIRS) is not joined: what lies between what is
already known to be equal is cut in two even segments again, by the same argument, until few share one or a single
code point is left. So no group is expanded into all its pairs, and no link is lost.

The query's data have faults put in: of a run whose crc32 with its document's id is divisible by FAULT a code point is
left out, and words are what then stands there. count_words() counts plain runs unless that is asked for.

Null and empty texts have no words, rows that repeat count again, a null id is the empty text before the colon; ids may be
of any type, as text. Ties between forms go to the first in code-point order. Other columns are not read. No text
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import PASS, checkpoint, documents, frugal, trim

LETTERS, NOT_LETTER, SHORTEST, FEWEST, FAULT, RATIO = "a-zÀ-ÿ", re.compile("[^a-zÀ-ÿ]"), 5, 3, 97, 2
#: Pairs of words that may share a segment before it is cut again, and words that a task counts before it sends them.
PAIRS, HELD = 1 << 14, 200_000


def parts(text: str, most: int = PASS):
    """A text in parts of some most characters, never cut within a run of letters."""
    at = 0
    while at < len(text):
        m = NOT_LETTER.search(text, at + most)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def words_of(text: str, shortest: int = SHORTEST) -> Counter:
    """Maximal runs of letters of a text that have as many code points; only A to Z are lower-cased."""
    found = Counter()
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")
    for part in parts(text.encode("utf-8", "replace").lower().decode("utf-8")):
        found.update(run.findall(part))
    return found


def faulty(word: str, start: int, fault: int) -> str:
    """The word as it counts in the document whose id and colon have this crc32."""
    h = zlib.crc32(word.encode(), start)
    if h % fault:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, fault: int | None = None) -> DataFrame:
    """(word, n) of all words that occur often enough; tasks send counts, not occurrences."""

    def run(frames):
        frugal()
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in frames:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{ids[i].as_py() or ''}:".encode())
                for word, n in words_of(text, shortest).items():
                    if fault and len(word := faulty(word, start, fault)) < shortest:
                        continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()
        trim()

    picked = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def segments(rows: DataFrame) -> DataFrame:
    """Each row for both even segments of what lies between its first a and last b equal code points."""
    middle = F.col("l") - F.col("a") - F.col("b")
    half = F.floor(middle / 2).cast("int")
    cuts = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + middle - half).alias("b")))
    out = rows.withColumn("cut", F.explode(cuts)).select("word", "n", "longer", "l", F.col("cut.a").alias("a"), F.col("cut.b").alias("b"))
    return out.withColumn("cell", F.xxhash64("l", "a", "b", F.left("word", "a"), F.right("word", "b")))


def candidates(rows: DataFrame) -> DataFrame:
    """Verified pairs of words that share a cell."""
    index = rows.where("not longer").select("cell", F.col("word").alias("u"), F.col("n").alias("nu"))
    probe = rows.select("cell", F.col("word").alias("v"), F.col("n").alias("nv"), "longer")
    met = index.join(probe, "cell").where("longer or v > u")
    return met.where(F.levenshtein("u", "v", 1) == 1).select("u", "nu", "v", "nv")


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(u, nu, v, nv) of each pair of words one edit apart, once."""
    size = F.char_length("word")
    both = F.array(F.struct(size.alias("l"), F.lit(False).alias("longer")), F.struct((size - 1).alias("l"), F.lit(True).alias("longer")))
    rows = words.withColumn("as", F.explode(both)).select("word", "n", F.col("as.longer").alias("longer"), F.col("as.l").alias("l"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    found = None
    while True:  # at most as often as the longest word's length can be halved
        rows = checkpoint(segments(rows))
        own, other = F.sum(F.when(F.col("longer"), 0).otherwise(1)), F.sum(F.when(F.col("longer"), 1).otherwise(0))
        many = rows.where("l - a - b > 1").groupBy("cell").agg((own * (own + other)).alias("pairs")).where(F.col("pairs") > pairs).select("cell")
        many = checkpoint(many)
        some = not many.isEmpty()
        got = candidates(rows.join(many, "cell", "left_anti") if some else rows)
        found = got if found is None else found.union(got)
        if not some:
            return found.distinct()
        rows = rows.join(many, "cell", "left_semi").drop("cell")


def roots(steps: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling: each round a word takes its form's form. Forms have higher
    counts than their words, so there is no cycle, and rounds are as many as the logarithm of the longest chain."""
    at = checkpoint(steps.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("mid"), F.col("root").alias("end"))
        at = checkpoint(at.join(on, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the words (word, n), which are distinct."""
    words = checkpoint(words)
    links = checkpoint(near_words(words, pairs))
    ends = F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("m")), F.struct(F.col("v").alias("word"), F.col("u").alias("near"), F.col("nu").alias("m")))
    best = links.select(F.explode(ends).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")))
    out = checkpoint(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form["form"].alias("form"), form["form_n"].alias("form_n")))
    out = out.join(roots(out.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(count_words(documents(spark, sf_dir), fault=FAULT))


#: crc32 has no function in this SQL: it is folded over the bytes by the polynomial's table. Levenshtein there counts bytes, so the
#: accented letters are first mapped to single bytes.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
    SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents
), told AS (SELECT id, w, count(*) AS c FROM runs WHERE length(w) >= 5 GROUP BY id, w
), hashed AS (
    SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(id || ':' || w)) + 1), lambda p: ('0x' || substr(hex(encode(id || ':' || w)), 2 * p::INT - 1, 2))::BIGINT)),
        lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1])), 4294967295) AS h FROM told, crc
), made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed
), words AS (
    SELECT word, sum(c)::BIGINT AS n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}') AS x
    FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), near AS (SELECT a.word, b.word AS other, b.n AS m FROM words a JOIN words b ON abs(length(a.x) - length(b.x)) <= 1 AND a.word <> b.word WHERE levenshtein(a.x, b.x) = 1
), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)
), chain AS (
    SELECT word, word AS tip, 0 AS k FROM formed
    UNION ALL
    SELECT c.word, f.form, c.k + 1 FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(tip, k) AS root FROM chain GROUP BY word) r USING (word)
"""
