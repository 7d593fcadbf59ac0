"""Archives, search, chat, and the registered queries against their SQL."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from rastrum.llm import chat, topk, warc
from rastrum.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        place = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place + '/*.parquet' if Path(place).is_dir() else place}'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert ordered(map(tuple, got.select(*columns).collect())) == ordered(con.sql(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall())


PAGES = "page_id long, url string, html string, payload string, digest string"


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big = "é" * 600
    rows = [(1, "http://a.example.com/x", big), (5, "http://b.example.com/", big), (3, None, big), (4, "not a url\n", None), (6, "HTTP://User@Example.COM:8080", ""), (None, "http://n", big), (5, "http://b.example.com/", big)]
    rows += [(100 + k, f"http://h{k % 3}.org/{k}", f"page {k}") for k in range(20)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    entries, folder, top = warc.archive(pages, str(tmp_path / "w"))
    got = warc.read_captures(entries, folder, top).collect()
    sha = lambda b: hashlib.sha1(b).hexdigest()
    want = Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = html == big and i in (1, 3)
        want[i, "revisit" if revisit else "response", 5 if revisit else None, len(b), sha(b), None if revisit else b] += 1
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got) == want
    missing = spark.createDataFrame([("org,h0)/0", 100), ("org,h0)/0", 7), ("zzz", 1), ("", -5)], "key string, page_id long")
    assert [r.page_id for r in warc.read_captures(missing, folder, top).collect()] == [100]
    assert warc.sort_key("HTTP://User@Example.COM:8080") == "com,example:8080)/" and warc.sort_key(None) == ""
    entries, folder, top = warc.archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_captures(entries, folder, top).isEmpty()


def test_top_k(spark):
    random = np.random.default_rng(6)
    base = random.normal(0, 0.12, (300, 16)).astype(np.float32)
    base[50:60] = base[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(1000, None), (1001, [None] + [0.1] * 15), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (None, [0.5] * 16), (1100, [0.25] * 4), (1200, [0.0] * 16), (7, rows[7][1])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    got = ordered(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, block=64).collect()))
    sound = {}
    for i, v in rows + odd:
        if i is not None and v and None not in v and np.isfinite(v).all():
            sound.setdefault(i, []).append(np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int))
    want = []
    for q in (i for i in sound if i % 100 == 0):
        scores = sorted((-int(v @ sound[q][0]), i) for i, vs in sound.items() if i != q for v in vs if len(v) == len(sound[q][0]))[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == ordered(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 10).isEmpty()
    read = topk.tiled(vectors, vectors.where("vec_id % 100 = 0"), 10, block=64).agg({"share": "max"}).first()[0]
    assert 0 < read <= 1


def test_top_k_of_large_components(spark):
    random = np.random.default_rng(7)
    rows = [(i, (random.normal(0, 1, 4) * 10.0 ** random.integers(0, 30)).tolist()) for i in range(60)]
    rows += [(100, [3e6] * 4), (200, [1e30, -1e30, 1e30, 2.0]), (300, [1e30, -1e30, 1e30, 2.0009765625]), (400, [1.7e308] * 4), (500, [1.1e305, 0.0, 0.0, -1e305])]
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, v string, score string")
    vectors = topk.integer_vectors(data)
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if np.isfinite(1024 * np.array(v)).all()}
    assert {r.vec_id for r in vectors.collect()} == set(whole)
    got = ordered(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, block=16).collect()))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, r, i, clip(-s)) for r, (s, i) in enumerate(scores, 1)]
    assert got == ordered(want)


def test_preference_pairs(spark):
    rows = [
        (1, True, 0, "user", "Hi <|turn|>"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "Hi <|turn|>"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", None),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, True, 0, None, None), (None, True, 0, "user", "x"), (4, None, 0, "user", "x"), (5, False, 1, "user", "b"), (5, False, None, "assistant", "a"), (5, False, 1, "user", "b"),
    ]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "pair_id long, is_chosen boolean, turn long, role string, text string, prompt int, c int")
    out = {r.pair_id: r for r in chat.preference_pairs(turns).collect()}
    assert set(out) == {1, 2, 3, 5}
    one = out[1]
    assert one.n_common == 1 and one.prompt == "<|turn|>user\nHi < |turn|><|end|>\n" and one.chosen == "<|turn|>assistant\ngood<|end|>\n"
    span = lambda text, mask: [text[slice(*map(int, m.split(":")))] for m in mask.split(",") if m]
    assert span(one.chosen, one.chosen_mask) == ["good<|end|>"] and span(one.rejected, one.rejected_mask) == ["bad<|end|>"]
    assert out[2].chosen == out[2].rejected == "" and out[2].n_common == 1
    assert out[3].chosen == "<|turn|>\n<|end|>\n" and out[3].rejected == ""
    assert out[5].rejected.startswith("<|turn|>assistant\na<|end|>") and out[5].rejected.count("\nb<") == 2
    assert chat.preference_pairs(turns.limit(0)).isEmpty()


def test_pipeline(spark, documents, odd_rows):
    rows = odd_rows + [(700 + k, "\n".join(f"line {j} of text number {k} with some words to read and token{j}" for j in range(12))) for k in range(30)]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert stage(spark, before.limit(0), DATA).isEmpty()
    assert not docs.isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "best_fit_packing"]
