"""The operators' inner parts against enumeration and the public libraries."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import bpe, components, decontaminate, hnsw, lattice, linedup, quality, segment, simhash, unigram, wavelet
from lamina.llm.queries import vocabulary
from tests.llm import brute

TEXT = st.text(st.sampled_from("abcdeTHxyz0123 \n\t.,!'s’é日 　\x00\x1f*|"), max_size=60)


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=segment.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_is_the_library(coder, library, texts):
    ids = coder.encode_all(pa.array(texts))
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(i) for i in ids] == [t.encode() for t in texts]


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abstmdrevl''\" \n\t\x85\u3000\x1c1²!é日🙂\u0308"), max_size=16)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pretokens_are_the_patterns_matches(texts):
    import regex

    pieces = segment.pretokens(pa.array([None, "x", *texts], pa.string()).slice(2))
    own = pieces.distinct()
    got = [[own[c] for c in pieces.codes[a:b]] for a, b in zip(pieces.starts, pieces.starts[1:])]
    assert got == [regex.findall(segment.PATTERN, t or "") for t in texts]


def test_store_forgets(coder):
    texts = pa.array([f"w{i % 50} x{i} w{i % 50}, x{i}" for i in range(400)])
    want = [i.tolist() for i in coder.encode_all(texts)]
    small = bpe.ByteBPE(coder.ranks)
    small.store.limit = 20
    got = [i.tolist() for k in range(0, 400, 16) for i in small.encode_all(texts.slice(k, 16))]
    assert got == want and len(small.store.place) < 200


def test_perfect_hash(coder):
    h = coder.whole
    assert sorted(h.ids) == list(range(h.n)) and all(h.get(k) == v for k, v in coder.ranks.items())
    assert h.get(b"surely not a token of it") == -1 and bpe.PerfectHash({}).get(b"x") == -1


@given(st.lists(TEXT, min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_token_ids_are_the_library(texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    with open(path, "rb") as f:
        mine = wavelet.Encoder(f.read(), 0).encode(pa.array(texts))
    t = Tokenizer.from_file(path)
    assert [m.tolist() for m in mine] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


@pytest.mark.parametrize("n,sigma", [(0, 1), (1, 1), (70_000, 1), (200_000, 900), (5_000, 70_000)])
def test_wavelet(n, sigma):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=sigma).astype("<u4")
    w = wavelet.WaveletMatrix(wavelet.build(ids, [5, None], np.array([n, 0])))
    assert (w.ids() == ids).all() and w.doc_ids == [5, None] and w.n == n
    for i in {0, n // 2, n - 1} if n else ():
        t = int(ids[i])
        spots = np.flatnonzero(ids == t)
        assert w.access(i) == t and w.count(t) == len(spots) and w.rank(t, i) == (spots < i).sum()
        assert w.select(t, 0) == spots[0] and w.select(t, len(spots) - 1) == spots[-1]
        assert w.count(t, n // 3, n // 2) == ((spots >= n // 3) & (spots < n // 2)).sum()
    assert w.count(10**6) == 0
    with pytest.raises(IndexError):
        w.select(10**6, 0)


PIECES = {"▁": -5.0, "▁a": -2.0, "a": -3.0, "b": -3.0, "ab": -5.0, "ba": -6.0, "▁ab": -6.0, "aa": -6.0, "▁▁": -7.0, "abb": -8.0}


@given(st.text("ab  \nzé", max_size=14))
@settings(max_examples=300, deadline=None)
def test_viterbi_is_the_library(text):
    from tokenizers import Tokenizer, models, normalizers

    for fallback in (True, False):
        vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *PIECES.items()] if fallback else [("<unk>", 0.0), *PIECES.items()]
        t = Tokenizer(models.Unigram(vocab, 0, fallback))
        t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        mine = unigram.PieceCounter(PIECES, fallback)
        assert mine.count(text)[0] == len(t.encode(text).ids), (fallback, text)


@pytest.mark.parametrize("bucket", [1, 3, 48])
def test_links_connect_the_same(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), pair_bucket=bucket)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    want = brute.components(prints, list(range(len(prints))))
    mine = [roots.get(s, s) for s in signed]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    up = {i: i for e in edges for i in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.text("abc ", max_size=30), max_size=5), st.lists(st.text("abc ", max_size=12), max_size=4))
@settings(max_examples=200, deadline=None)
def test_wu_manber(texts, items):
    want = brute.contamination(list(enumerate(texts)), list(enumerate(items)), 3)
    owner: dict = {}
    for i, t in enumerate(items):
        for w in decontaminate.windows(decontaminate.words(t), 3):
            owner.setdefault(w, []).append(str(i))
    search = decontaminate.WuManber(owner)
    for (_, n, hit, found, _, _), t in zip(want, texts):
        spans, ids = decontaminate._spans(decontaminate.words(t), search, owner)
        assert (len(decontaminate.words(t)), sum(spans[1::2]) - sum(spans[::2]), len(ids)) == (n, hit, found)


def test_benchmark_in_blocks(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    find = lambda most: sorted((r.doc_id, r.n_words, tuple(r.spans), tuple(r["items"])) for r in decontaminate.find_overlap(docs, bench, ("doc_id",), most_windows=most).collect())
    assert decontaminate.benchmark_windows(bench, "item_id", "text", 10).count() > 400
    assert find(150) == find(1 << 25)


@given(st.lists(st.lists(st.sampled_from(["a b", "c d e", "f", "g h", "", "  i  "]), max_size=9), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_patience(lists):
    """The aligned runs are as long as plain dynamic programming finds, and ascend."""
    for _, gone in brute.line_pairs([(i, "\n".join(x)) for i, x in enumerate(lists)]).values():
        for rows, longest in gone:
            run = linedup.patience([(a, b) for a, b, _ in rows])
            seconds = [rows[i][1] for i in run]
            assert len(run) == longest and seconds == sorted(set(seconds)) and run == sorted(run)


def test_line_dedup(spark):
    docs = [
        (1, "alpha beta gamma delta eps\nshared line of five words\nanother shared line with words\nshort"),
        (2, "own line with several words here\nshared line of five words\n\nanother shared line with words\nshort"),
        (3, "another shared line with words\nshared line of five words"),  # crossed: one of the two stays
        (4, "short\nx"),
        (5, "shared line of five words\nshared line of five words"),
        (6, "own line with several words here"),
    ]
    out = {r.doc_id: (r.text, r["__lines"], r["__cut"]) for r in linedup.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert out[1] == (docs[0][1], 4, 0)
    assert out[2] == ("own line with several words here\n", 4, 3)  # the short line goes with its block
    assert out[3][2] == 1 and out[4] == ("short\nx", 2, 0)
    assert out[5] == ("shared line of five words", 2, 1) and out[6][0] == ""


def _cut_of_all_pairs(docs, least=5):
    """doc_id: the number of deleted lines when every later document is aligned with every
    earlier one that shares a line."""
    numbered = []
    for i, t in sorted(docs):
        seen: dict = {}
        rows = []
        for x in (x.strip() for x in (t or "").split("\n") if x.strip()):
            seen[x] = seen.get(x, -1) + 1
            rows.append((x, seen[x]))
        numbered.append((i, rows, {key: p for p, key in enumerate(rows)}))
    out = {}
    for n, (i, rows, _) in enumerate(numbered):
        gone: set = set()
        for _, _, at in numbered[:n]:
            gone.update(linedup.aligned_blocks([(p, at[key], len(key[0].split())) for p, key in enumerate(rows) if key in at], least))
        out[i] = len(gone)
    return out


def _cut(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: r["__cut"] for r in linedup.remove_repeated_lines(df).collect()}


def test_line_dedup_partners(spark):
    """Blocks whose lines have earlier holders elsewhere, and lines crossed in the first holder."""
    x, y = "one two three four five", "six seven eight nine ten"
    docs = [
        (1, f"{x}\n{y}"), (2, f"{y}\n{x}"), (3, f"{y}\n{x}"),
        (11, "Les."), (12, "own a\nOf."), (13, "own b\nTo to."), (14, "own c\nMilk"), (15, "own d\nLes.\nOf.\nTo to.\nMilk"), (16, "own e\nLes.\nOf.\nTo to.\nMilk"),
    ]
    cut = _cut(spark, docs)
    assert cut[3] == 2 and cut[16] == 4 and cut[15] == 0
    assert cut == _cut_of_all_pairs(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    lines = ["a", "b", "c d", "e f g", "h i j k l", "m n o p q r", "s t u v w x", "y"] + [f"rare {i}" for i in range(30)] + [f"rare line {i} of words" for i in range(30)]
    weight = np.r_[np.full(8, 4.0), np.full(60, 0.3)]
    docs = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9), p=weight / weight.sum()))) for i in range(400)]
    docs += [(i + 400, docs[int(j)][1]) for i, j in enumerate(rng.integers(0, 400, 60))]
    assert _cut(spark, docs) == _cut_of_all_pairs(docs)


def test_line_dedup_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _cut(spark, docs) == _cut_of_all_pairs(docs)


@given(st.lists(st.integers(1, 7), max_size=9))
@settings(max_examples=200, deadline=None)
def test_covering_runs(words):
    runs = linedup.covering_runs(words, 5)
    for a, b in itertools.combinations(range(len(words) + 1), 2):
        if sum(words[a:b]) >= 5:
            assert {p for s, e in runs if a <= s and e <= b for p in range(s, e)} == set(range(a, b))


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 3, 4])
    score = rng.normal(size=(3, 4)) * 2
    start, step = rng.normal(size=2), rng.normal(size=(2, 2))
    one, moves, z = quality.forward_backward(score, lengths, start, step)
    want = np.zeros((2, 2))
    for d, n in enumerate(lengths):
        total, at, mv = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(start[y[0]] + sum(score[d, i] * y[i] for i in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += w
            at += w * np.array(y)
            for a, b in zip(y, y[1:]):
                mv[a, b] += w
        assert z[d] == pytest.approx(math.log(total)) and one[d, :n] == pytest.approx(at / total)
        want += mv / total
    assert moves == pytest.approx(want)


def test_groups_are_small():
    for lengths in ([], [5], [1] * 700, [1, 2, 300_000], sorted([3] * 10 + [900] * 500)):
        groups = list(quality._groups(lengths))
        assert [i for g in groups for i in g] == list(range(len(lengths)))
        assert all(len(g) == 1 or len(g) <= 256 and len(g) * lengths[g[-1]] <= 200_000 for g in groups)


def _segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in _segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_lattice_is_enumeration():
    lat = lattice.Lattice({"▁": 1.0, "▁a": 2.0, "a": 1.0, "b": 3.0, "ab": 1.0, "▁ab": 0.5, "bb": 0.2})
    total = 0.0
    for n in range(0, 7):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            p = sum(
                math.exp(lat.first[s[0]] + sum(lat.rest[x] for x in s[1:]) + (len(s) - 1) * lat.go + lat.stop)
                for s in _segmentations("▁" + word, {**lat.first, **lat.rest}) if s[0] in lat.first and all(x in lat.rest for x in s[1:])
            )
            assert 10 ** lat.log10([word, "ba"])[0] == pytest.approx(p)
            total += p
    assert 0.5 < total < 1
    counts, spelled, steps = lat.expect(["abab", "b"])
    for word, into in (("abab", 1), ("b", 1)):
        found = [(s, math.exp(lat.first[s[0]] + sum(lat.rest[x] for x in s[1:]) + (len(s) - 1) * lat.go)) for s in _segmentations("▁" + word, {**lat.first, **lat.rest}) if s[0] in lat.first]
        z = sum(w for _, w in found)
        for i, piece in enumerate(lat.pieces):
            counts[i] -= into * sum(w * s.count(piece) for s, w in found) / z
        steps -= sum(w * (len(s) - 1) for s, w in found) / z
    assert np.abs(counts).max() < 1e-9 and abs(spelled) < 1e-9 and abs(steps) < 1e-9
    odd = lat.log10(["z日", "ab", ""])
    assert odd[0] < odd[1] and lattice.Lattice({}).log10(["xy"])[0] < 0
    lone = [float(lat.log10([w])[0]) for w in ("z日", "ab", "", "abba" * 20)]
    assert lat.log10(["z日", "ab", "", "abba" * 20]) == pytest.approx(lone)
    assert lat.expect(["zz"])[1] == pytest.approx(2)
    again = lat.learned(*(x for x in lat.expect(["abab", "zb"])[:2]), 2.0, prior=1e-6)
    assert again.log10(["abab", "zb"]).sum() > lat.log10(["abab", "zb"]).sum()


def test_rising():
    x, n = np.array([1e-7, 0.3, 5.0, 1e-3, 2.0]), np.array([1, 2, 3, 400, 30])
    want = [sum(math.log10(a + j) for j in range(b)) for a, b in zip(x, n)]
    assert lattice.rising(x, n) == pytest.approx(want, rel=1e-10)


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBÉé \n\t\x0b\x85\u3000日"), max_size=12)), max_size=5))
@settings(max_examples=100, deadline=None)
def test_words_of(texts):
    own, codes, at = lattice.words_of(pa.array([None, "x y", *texts], pa.string()).slice(2))
    names = own.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(at, at[1:])] == [(t or "").encode().lower().split() for t in texts]


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    g = hnsw.Graph(x)
    hits = 0
    for q in rng.normal(size=(40, 24)):
        want = set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist())
        hits += len(want & set(g.search(q, 10, 128)))
    assert hits >= 0.9 * 400
    assert hnsw.Graph(x[:1]).search(x[0], 5, 10) == [0]


@pytest.mark.parametrize("shift,scale", [(1000.0, 1.0), (0.0, 1e30), (1e30, 1e20), (0.0, 1e200)])
def test_graph_recall_anywhere(shift, scale):
    """Vectors away from the origin, and large ones, are found as well as centred ones."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)) * scale + shift
    x[0] = shift - 30 * scale
    g = hnsw.Graph(x)
    hits = 0
    for q in rng.normal(size=(30, 16)) * scale + shift:
        want = set(np.argsort((((x - q) / scale) ** 2).sum(axis=1))[:10].tolist())
        hits += len(want & set(g.search(q, 10, 128)))
        rows, far = g.found(q, 128)
        assert len(rows) == 128 and far == pytest.approx(scale * np.sqrt((((x[rows] - q) / scale) ** 2).sum(axis=1)))
    assert hits >= 0.9 * 300


def test_shards_merge(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 8)), 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = hnsw.nearest(df, every=50, k=5, shard_rows=100, block=7).collect()
    right = 0
    for q in range(0, 900, 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = {int(j) for j in np.lexsort((np.arange(900), far)) if j != q and True}
        want = [int(j) for j in np.lexsort((np.arange(900), far)) if j != q][:5]
        right += len(set(want) & {r.vec_id for r in found if r.query_id == q})
    assert right >= 0.9 * 5 * 18 and len(found) == 5 * 18


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    end = "<|endoftext|>"
    texts = ["plain text", f"a {end} b", end, f"a{end}{end}  b", f"x  {end} ", f"{end}\n\n y", f"cut <|endoftext| >{end[:-1]}", f"<{end}>", "", f" {end} 's{end}'s"]
    with open(path, "rb") as f:
        encoder = wavelet.Encoder(f.read(), 0)
    whole = Tokenizer.from_file(path)
    for got, t in zip(encoder.encode(pa.array([*texts, None])), [*texts, ""]):
        assert np.frombuffer(got, "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0]


def test_starts_count_added_tokens(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    rows = wavelet.token_table(docs, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in rows] == [(0, 5), (5, 2)]
