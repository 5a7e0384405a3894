"""The contract queries over a whole small table, against plain versions and the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from lamina.llm import queries as Q
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_op1(spark, sf, docs):
    from tokenizers import Tokenizer, models, normalizers

    from lamina.llm import unigram

    pieces, fallback = unigram.read_pieces(Q.vocabulary("piece_bpe_32k.model"))
    assert fallback
    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces.items()]
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r.doc_id: r.n_tokens for r in Q.op1_viterbi_count(spark, sf).collect()}
    assert got == {i: len(t.encode(d.text or "").ids) for i, d in docs.items()}


def test_op2(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    got, start = {r.doc_id: tuple(r) for r in Q.op2_wavelet_tokens(spark, sf).collect()}, 0
    for i in sorted(docs):
        ids = np.array([*t.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op3(spark, sf, docs):
    got = {r.doc_id: r for r in Q.op3_simhash(spark, sf).collect()}
    ids = sorted(docs)
    prints = [brute.fingerprint(docs[i].text) for i in ids]
    assert [int(got[i].fingerprint, 16) for i in ids] == prints
    assert [got[i].component_id for i in ids] == brute.components(prints, ids)


def test_op4(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination([(i, d.text) for i, d in docs.items()], items)
    assert sorted(tuple(r) for r in Q.op4_decontaminate(spark, sf).collect()) == sorted(want)
    assert any(w[-1] for w in want)


def test_op4_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.execute(Q.oracle_sql()["op4_decontaminate"]).fetchall()) == sorted(tuple(r) for r in Q.op4_decontaminate(spark, sf).collect())


def test_op6(spark, sf, docs):
    want = brute.base_scores([(i, d.text) for i, d in docs.items()])
    rows = Q.op6_lattice_lm(spark, sf).collect()
    for r in rows:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, brute.crc(r.doc_id) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert len(rows) == len(docs)


def test_op6_scores(spark):
    """Against a version that goes through words and classes one by one."""
    from lamina.llm import lattice, unigram

    rows = [(i, f"alpha beta {w} gamma {w} delta {'x' * (i % 5)} Ärger {w}{i}", lang) for i, (w, lang) in enumerate([("one", "en"), ("zwei", "de"), ("uno", None)] * 6)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "alpha " * 40 + "neu 日本", "fr")]
    weights = lattice.rank_weights(unigram.read_pieces(Q.vocabulary("piece_bpe_32k.model"))[0])
    want = brute.lattice_scores(rows, weights)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for cells in (500_000, 12, 0):
        got = {r.doc_id: r.score for r in lattice.score_documents(df, weights, head_cells=cells).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_op7(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    got: dict = {}
    for r in Q.op7_hnsw(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    right = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - vectors[q]) ** 2).sum(axis=1))
        want = [int(ids[j]) for j in np.lexsort((ids, far)) if ids[j] != q][:10]
        mine = [got[q][k] for k in range(1, 11)]
        assert mine == sorted(mine, key=lambda m: (m[1], m[0]))
        assert all(s == pytest.approx(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()), abs=1e-12) for i, s in mine)
        right += len(set(want) & {i for i, _ in mine})
    assert right >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()


def test_op8(spark, sf, docs):
    import tiktoken

    from lamina.llm.segment import PATTERN

    with open(Q.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in Q.op8_byte_bpe(spark, sf).collect():
        ids = e.encode_ordinary(docs[r.doc_id].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()


def test_op9(spark, sf, labels):
    rows = Q.op9_quality_crf(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (brute.crc(r.doc_id) % 4 == 2) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean(held) >= 0.9


def test_op9_scores(spark, sf, docs):
    """Every text's score against plain forward and backward sums under the same model."""
    from lamina.llm import quality

    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in Q.op9_quality_crf(spark, sf).collect()}
    assert got == pytest.approx({i: brute.crf_score(model, d.text) for i, d in docs.items()}, abs=1e-6)


def test_op10_predictions(spark, sf, docs):
    want = brute.languages([(i, d.text, d.lang) for i, d in docs.items()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in Q.op10_language_rank(spark, sf).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert [got[i][1] for i in sorted(got)] == pytest.approx([want[i][1] for i in sorted(got)], abs=1e-9)


def test_op10(spark, sf, docs):
    rows = Q.op10_language_rank(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (brute.crc(r.doc_id) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]) >= 0.95
