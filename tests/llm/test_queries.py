"""Every registered query of the training-data operators over a whole table, against SQL or brute force."""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tools.check_oracle import TABLES, rows_of, type_mismatches
from tripleval.llm import queries as llm
from tripleval.llm import secrets


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("key", sorted(llm.oracle_sql()))
def test_sql_twin(spark, sf_dir, con, key):
    df = llm.queries()[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(llm.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert type_mismatches(df, con.sql(llm.oracle_sql()[key])) == {}
    assert rows_of(df.columns, rows) == rows_of(cols, cur.fetchall())


def test_fingerprints(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in llm.queries()["op1_document_fingerprints"](spark, sf_dir).collect()}
    down = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    by_text, off, off_next = {}, [], []
    for k, (i, text) in enumerate(down):
        nxt, half = down[(k + 1) % len(down)][1], len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), brute.sha(edited))
        a, b, c = (brute.shingle_set(t, lower=False) for t in (text, edited, nxt))
        off.append(got[i]["near_edited"] - len(a & b) / len(a | b))
        off_next.append(got[i]["near_next"] - len(a & c) / len(a | c))
        by_text.setdefault(text, set()).add(got[i]["fingerprint"])
        by_text.setdefault(edited, set()).add(got[i]["edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert np.abs(off).mean() < 0.05 and abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.25
    assert np.abs(off_next).mean() < 0.01


def test_packing(spark, sf_dir, docs):
    rows = llm.queries()["op3_best_fit_packing"](spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s:s + 4096]
            want[i, piece] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == math.ceil(sum(n for _, n, _ in want.values()) / 4096)


def test_secrets(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in llm.queries()["op5_secret_scan"](spark, sf_dir).collect()}
    for i, text in docs:
        spans = brute.base_spans(text)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == counts
        assert got[i]["base_sha256"] == brute.sha(said)
        base = [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")]
        assert ",".join(base) == said


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = llm.queries()["op8_toxicity"](spark, sf_dir)
    rows = out.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.85
    assert sum(clean) / len(clean) < 0.02
