"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from lamina.llm import bpe, decontaminate, hnsw, language, lattice, linedup, quality, simhash, unigram, wavelet
from lamina.llm.queries import vocabulary

ROWS = [
    (1, "The cat sat on the mat. And the dog ran off.\nA second line of five words.", "en"),
    (1, "The cat sat on the mat. And the dog ran off.\nA second line of five words.", "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "no id here\nA second line of five words.", None),
    (4, "word " * 30_000 + "end", "en"),
    (5, "x" * 50_000, "xx"),
    (6, " \n\t　\x00 !!", "en"),
    (7, "Ça été à l’école où  naïve 日本 🙂", "fr"),
]
CLASH = ["n_tokens", "start", "component_id", "score", "lang_pred", "held_out", "predicted", "fp", "key", "h", "cut", "rank"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the dog ran off"), (2, None), (None, "no id"), (1, "cat sat on"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 0), (4, 0, 1), (5, 0, None), (6, None, 0), (None, 1, 1), (1, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def weights():
    return lattice.rank_weights(unigram.read_pieces(vocabulary("piece_bpe_32k.model"))[0])


def run(name, docs, bench, labels):
    if name == "unigram":
        return unigram.token_counts(docs, *unigram.read_pieces(vocabulary("piece_bpe_32k.model")))
    return {
        "wavelet": lambda: wavelet.token_table(docs, vocabulary("byte_bpe_50k.json")),
        "simhash": lambda: simhash.simhash_components(docs),
        "decontaminate": lambda: decontaminate.contamination(docs, bench),
        "linedup": lambda: linedup.line_dedup_report(docs),
        "lattice": lambda: lattice.score_documents(docs, weights()),
        "bpe": lambda: bpe.encode_table(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken")),
        "quality": lambda: quality.document_quality(docs, labels),
        "language": lambda: language.predict_language(docs),
    }[name]()


NAMES = ["unigram", "wavelet", "simhash", "decontaminate", "linedup", "lattice", "bpe", "quality", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, bench, labels, name):
    rows = run(name, docs, bench, labels).collect()
    assert len(rows) == len(ROWS) and sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twice = [tuple(r) for r in rows if r.doc_id == 1]
    if name != "wavelet":
        assert twice[0] == twice[1]
    by = {r.doc_id: r for r in rows}
    if name == "unigram":
        assert by[2].n_tokens == by[3].n_tokens == 0
    if name == "wavelet":
        assert by[2].n_tokens == by[3].n_tokens == 1 and sorted(r.start for r in rows)[0] == 0
        ordered = sorted(rows, key=lambda r: r.start)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
        assert [r.doc_id for r in ordered] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    if name == "simhash":
        assert by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 2
    if name == "decontaminate":
        assert by[1].n_hit == 7 and by[1].n_items == 1 and by[None].n_hit == 2 and by[None].n_items == 0 and by[None].contaminated
        assert by[2].n_words == 0 and not by[2].contaminated
    if name == "linedup":
        assert by[None].n_deleted == 1 and by[1].n_deleted == 0 and by[2].n_lines == 0
    if name == "lattice":
        assert by[2].n_tokens == by[3].n_tokens == 1 and not by[None].held_out
    if name == "language":
        assert by[2].lang_pred == by[3].lang_pred == by[6].lang_pred == "und"


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, bench, labels, name):
    none = docs.where("false")
    assert run(name, none, bench.where("false"), labels.where("false")).count() == 0


def test_nothing_to_learn_from(docs, bench, labels):
    assert {r.score for r in quality.document_quality(docs, labels.where("false")).collect()} == {0.5}
    assert {r.lang_pred for r in language.predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.where("false")).collect())
    one = docs.where("doc_id = 3 or doc_id = 2")
    held = lattice.score_documents(one, weights(), mod=1, held=0).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in held)


def test_missing_column(docs):
    with pytest.raises(ValueError):
        simhash.simhash_components(docs.drop("text"))


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [2.0, 2.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0]), (200, [1.0, 1.0, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in hnsw.nearest(df).collect())
    root2 = 2.0**0.5
    assert got == [(0, 1, 8, 0.0), (0, 2, 100, 0.0), (0, 3, 9, root2), (100, 1, 0, 0.0), (100, 2, 8, 0.0), (100, 3, 9, root2)]
    assert hnsw.nearest(df.where("false")).count() == 0
