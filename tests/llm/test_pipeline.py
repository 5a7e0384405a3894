"""Each stage on its own input against a plain version of its decision."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lamina.llm import linedup, simhash
from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    names = steps[0][0].columns
    assert all(after.columns == names for _, after in steps[:-1])


def test_quality(spark, sf, steps):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = map(_texts, steps[0])
    assert all(before[i] == t for i, t in after.items())
    judged = [(i in after) == (good[i] == 1) for i in before if good.get(i) is not None]
    assert sum(judged) >= 0.95 * len(judged)


def test_lines(steps):
    before, after = map(_texts, steps[1])
    first = {}
    for i in sorted(before):
        for line in set((before[i] or "").split("\n")):
            first.setdefault(line.strip(), i)
    for i, t in after.items():
        kept, was = (t or "").split("\n"), (before[i] or "").split("\n")
        assert set(kept) <= set(was) | {""}
        gone = list(was)
        for line in kept:
            if line in gone:
                gone.remove(line)
        assert all(first[x.strip()] <= i for x in gone)
    assert all((before[i] or "").strip() for i in before.keys() - after.keys())
    assert all(r.n_chars == len(r.text) for r in steps[1][1].where("text is not null").collect())


def _copies(before):
    """Ids of each set of equal texts that have the least words of a block."""
    sets = {}
    for i, t in sorted(before.items()):
        if len((t or "").split()) >= 5:
            sets.setdefault(t, []).append(i)
    return [ids for ids in sets.values() if len(ids) > 1]


def test_lines_keep_one_copy(spark, sf, steps):
    """Of equal texts at most the first document is left after the line stage; those of
    under five words, which no block may delete, go with the near copies."""
    before, after = map(_texts, steps[1])
    found = _copies(before)
    assert found and not {i for ids in found for i in ids[1:]} & after.keys()
    rows = [(1, "Les."), (2, "one two three four five\nsix seven eight nine ten"), (3, "own line of this text\nLes.\nlast line of this text"), (4, "six seven eight nine ten\none two three four five"), (5, "six seven eight nine ten\none two three four five"), (6, "own line of this text\nLes.\nlast line of this text")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert {5, 6}.isdisjoint(_texts(P.dedup_lines(spark, made, sf)))
    assert len(set(_texts(steps[2][1]).values())) == len(_texts(steps[2][1]))


def test_near(steps):
    before, after = map(_texts, steps[2])
    ids = sorted(before)
    want = set(brute.components([brute.fingerprint(before[i]) for i in ids], ids))
    assert after.keys() == want and all(before[i] == t for i, t in after.items())


def test_decontaminated(spark, sf, steps):
    before, after = map(_texts, steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert after.keys() == {r[0] for r in brute.contamination(list(before.items()), items) if not r[-1]}


def test_encoded(steps):
    before = _texts(steps[4][0])
    rows = steps[4][1].collect()
    assert {r.doc_id for r in rows} == before.keys() and all(r.n_tokens == len(r.ids) for r in rows)
    import tiktoken

    from lamina.llm import bpe, segment
    from lamina.llm.queries import vocabulary

    library = tiktoken.Encoding("own", pat_str=segment.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r.ids == library.encode_ordinary(before[r.doc_id] or "") for r in rows)


def test_run_is_the_stages(spark, sf, steps):
    got = P.run(spark, sf)
    assert sorted(map(tuple, got.drop("ids").collect())) == sorted(map(tuple, steps[-1][1].drop("ids").collect()))


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (None, "q r s t u", "z"), (None, "q r s t u", "z"), (None, None, "n"), (3, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    kept = simhash.drop_near_copies(df).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == ["(1, 'a b c d')", "(3, '')", "(None, 'q r s t u')"]
    cut = linedup.remove_repeated_lines(df)
    assert cut.count() == 7 and cut.columns[:3] == df.columns
    assert cut.where(F.col("doc_id") == 2).first().text == "a b c d"  # four words: under the least


ODD = ["score", "__cut", "__c0", "key", "fp", "spans", "n_tokens", "__k1", "__n", "root"]


def test_every_stage_takes_odd_rows(spark, sf):
    """Nulls, empty texts, repeated rows, clashing and odd column names, an empty table."""
    rows = [(1, "Good words stand here, and they end well.", "en"), (1, "Good words stand here, and they end well.", "en"), (2, None, None), (3, "", "en"), (None, "no id here but some words", None), (None, None, "x"), (4, "x" * 60_000, "en"), (5, "w " * 20_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.select("*", F.lit(None).cast("long").alias("n_chars"), *(F.lit("clash").alias(c) for c in ODD), F.lit(1).alias("odd.name"))
    for name, stage in P.STAGES:
        out = stage(spark, df, sf)
        got = [tuple(r) for r in out.collect()]
        if name != P.STAGES[-1][0]:
            assert out.columns == df.columns
            assert set(map(str, got)) <= {str(tuple(r)) for r in df.collect()}
        else:
            assert len(got) == len(rows) and {r.doc_id: r.n_tokens for r in out.where("doc_id in (2, 3)").collect()} == {2: 0, 3: 0}
        assert stage(spark, df.where("false"), sf).count() == 0
    assert P.dedup_near(spark, df, sf).count() == 5  # 1, 2 (with 3 and the null text), no id, 4, 5
    assert P.decontaminate_benchmark(spark, df, sf).count() == len(rows)
    assert P.dedup_lines(spark, df, sf).where("doc_id = 2 and text is null").count() == 1


def test_encoded_columns_give_way(spark):
    from lamina.llm import bpe
    from lamina.llm.queries import vocabulary

    df = spark.createDataFrame([(1, "a b", 9, "keep")], "doc_id long, text string, n_tokens int, other string")
    out = bpe.encode_table(df, vocabulary("byte_bpe_50k.tiktoken"))
    assert out.columns == ["doc_id", "other", "n_tokens", "ids_sha256", "decoded_sha256"] and out.first().n_tokens == 2


def test_a_score_column_gives_way(spark, sf):
    from lamina.llm import quality

    df = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, score string")
    out = quality.with_quality(df, quality.LineCRF())
    assert out.columns == ["doc_id", "text", "score"] and out.first().score == 0.5
