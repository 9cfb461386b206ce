"""Every registered query on the smallest tables, against plain forms of what it promises."""

import hashlib
import zlib

import brute
import duckdb
import numpy as np
import pytest

from driftgauge.llm import media, mixing, queries
from driftgauge.session import ship


@pytest.fixture(scope="module")
def run(spark, sf):
    ship(spark)
    made = queries.queries()
    return lambda name: made[name](spark, sf).collect()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op1_op10(run, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op1_jaccard")} == brute.jaccard(texts.items())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run("op10_substring")} == brute.substring(texts.items())


def test_op2(run, texts):
    from tokenizers import Tokenizer

    from driftgauge.llm.bpe import default_path

    t = Tokenizer.from_file(default_path())
    got = {r.doc_id: r for r in run("op2_bpe")}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))


def test_op3(run, spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in run("op3_embeddings")}
    assert len(got) == len(rows) and sum(r.n_links for r in got.values()) >= 0.9 * links.sum()
    assert all(got[r.vec_id].n_links <= n and got[r.vec_id].kept == (got[r.vec_id].component_id == r.vec_id) for r, n in zip(rows, links, strict=True))


def test_op4(run, texts, spark, sf):
    got = {r.doc_id: r for r in run("op4_toxicity")}
    assert got.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in toxic if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.9


def test_op5(run, texts):
    from test_operators import plain_base

    for r in run("op5_secrets"):
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == sha(base.encode()) and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in base.split(",")) for k in ("assign", "access", "hex"))


def test_op6(run, texts):
    from driftgauge.llm import bpe

    b, pieces = bpe.load(bpe.default_path()), {}
    for r in run("op6_packing"):
        ids = np.frombuffer(r.input_ids, "<u2")
        for k, (d, at) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
            pieces.setdefault(d, []).append((at, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    assert {i: [x for _, p in sorted(v) for x in p][:-1] for i, v in pieces.items()} == {i: b.encode([t])[0].tolist() for i, t in texts.items()}


def plain_units(stream):
    """(bytes, timestamp, random access) of the one stream, packet by packet."""
    units, size = [], 0
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        if (p[1] & 0x1F) << 8 | p[2] != media.ES_PID:
            continue
        field = p[4] + 1 if p[3] & 0x20 else 0
        data = p[4 + field :]
        if p[1] & 0x40:
            assert data[:3] == b"\0\0\1"
            size = (data[4] << 8 | data[5]) - 3 - data[8]
            t = 0
            for x, bits in zip(data[9:14], ((0x0E, -29), (0xFF, -22), (0xFE, -14), (0xFF, -7), (0xFE, 1)), strict=True):
                t |= (x & bits[0]) << -bits[1] if bits[1] < 0 else (x & bits[0]) >> bits[1]
            units.append([b"", t, bool(field > 1 and p[5] & 0x40)])
            data = data[9 + data[8] :]
        units[-1][0] += data
    return units


def test_op7(run, texts, spark, sf):
    got = {r.doc_id: r for r in run("op7_media")}
    assert got.keys() == texts.keys()
    stored = {r.doc_id: r.media for r in media.store(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "media").collect()}
    for i, text in texts.items():
        raw, r = text.encode(), got[i]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        units = plain_units(stored[i])
        assert b"".join(u[0] for u in units) == payload and [u[1] for u in units] == r.pts and [k for k, u in enumerate(units) if u[2]] == r.random_access
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(stored[i]), sha(stored[i]))


def test_media_packets_of_one_counter():
    m = media.mux(b"x" * 40000)
    other = bytearray(m[188 * 9 : 188 * 10])
    other[100] ^= 1
    parsed = media.demux(m[: 188 * 10] + bytes(other) + m[188 * 10 :])
    assert parsed["faults"]["repeated"] == 0 and parsed["faults"]["lost"] == 1 and parsed["damaged"] == [0]
    cut = media.demux(m[: 188 * 10] + m[188 * 11 :])
    assert cut["damaged"] == [0] and media.demux(m)["damaged"] == []


def test_op8(run, sf):
    got = sorted(map(tuple, run("op8_mixing")), key=repr)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.sql(mixing.ORACLE_SQL).fetchall(), key=repr) == got


def test_op9(run, texts):
    got = {r.doc_id: r for r in run("op9_scoring")}
    assert got.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.n_tokens == len(brute.WORD.findall(texts[i])) + 1 and r.score < 0 for i, r in got.items())
    copies = {}
    for i, t in texts.items():
        copies.setdefault(t, []).append(i)
    twice = [i for v in copies.values() if len(v) > 1 and len(v[0:1]) for i in v if got[i].n_tokens > 50]
    once = [i for v in copies.values() if len(v) == 1 for i in v if got[i].n_tokens > 50]
    if twice:
        assert np.median([got[i].bits_per_byte for i in twice]) < 0.5 * np.median([got[i].bits_per_byte for i in once])
