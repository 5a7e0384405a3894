"""Tables in which a key has several rows."""

import hashlib
import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from lamina.model import TableSpec
from lamina.operators import chunks, diff, merge
from lamina.sources import sync
from lamina.sources.repository import Repository

SPEC = TableSpec(("k",), ("v",), repeats=True)
BASE = [(1, "a"), (2, "b"), (3, "c"), (5, "e")]
OURS = [(1, "a"), (1, "x"), (2, "B"), (3, "c"), (4, "n"), (4, "n"), (5, "e")]
THEIRS = [(1, "a"), (1, "y"), (2, "b"), (2, "z"), (4, "n"), (5, "e")]


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def content(df):
    return Counter((r.k, r.v) for r in df.collect())


def decided(base, ours, theirs):
    """Combinations of the sides' rows one by one."""
    out = Counter()
    for k in {k for k, _ in base + ours + theirs}:
        for b, o, t in product(*([v for x, v in side if x == k] or [None] for side in (base, ours, theirs))):
            kind = "same" if o == b == t else "ours" if t == b else "theirs" if o == b else "both" if o == t else "conflict"
            out[k, b, o, t, kind] += 1
    return out


def rows(df):
    return Counter((r.k, *(x and x.v for x in (r.base, r.ours, r.theirs)), r.outcome) for r in df.collect())


def test_patch_keeps_all_rows(spark):
    for a, b in ((BASE, OURS), (OURS, BASE), (OURS, THEIRS), (BASE, BASE)):
        changes = diff.bags(table(spark, a), table(spark, b), SPEC)
        assert content(diff.apply_bags(table(spark, a), changes, SPEC)) == Counter(b)
        assert content(diff.apply_bags(table(spark, b), diff.invert_bags(changes, SPEC), SPEC)) == Counter(a)


def test_merge_of_all_combinations(spark):
    sides = [table(spark, x) for x in (BASE, OURS, THEIRS)]
    want = decided(BASE, OURS, THEIRS)
    assert rows(merge.three_way(*sides, SPEC)) == want
    two = merge.from_bags(diff.bags(sides[0], sides[1], SPEC), diff.bags(sides[0], sides[2], SPEC), SPEC)
    assert rows(two) == Counter({x: n for x, n in want.items() if x[0] != 5})


def test_edits_make_the_merge(spark):
    base, ours, theirs = (table(spark, x) for x in (BASE, OURS, THEIRS))
    both = merge.from_bags(diff.bags(base, ours, SPEC), diff.bags(base, theirs, SPEC), SPEC)
    from lamina.operators.edits import apply_edits

    got = apply_edits(ours, merge.edits_on_ours(both, SPEC, merge.take_theirs), SPEC)
    assert content(got) == content(merge.merged(merge.three_way(base, ours, theirs, SPEC), SPEC, merge.take_theirs))


def test_versions_of_repeated_keys(spark, tmp_path):
    """Made whole or by edits, a version has one root; chunks close often, rows of a key are in several segments."""
    rng = random.Random(7)
    repo = Repository(spark, f"file://{tmp_path}/repo", SPEC, bits=1, file_bits=1)
    one = [(k, rng.choice("ab")) for k in range(60) for _ in range(rng.choice((1, 1, 2, 4)))]
    two = [r for r in one if r[0] % 7] + [(k, rng.choice("abc")) for k in range(0, 66, 3)]
    three = [r for r in one if r[0] % 5] + [(k, rng.choice("abz")) for k in range(0, 66, 4)]
    base = repo.commit("main", table(spark, one), None, "me", "base")
    repo.create_branch("side", "main")
    head = repo.commit_edits("main", diff.bag_edits(diff.bags(table(spark, one), table(spark, two), SPEC), SPEC), base.commit_id, "me", "edits")
    rng.shuffle(two)
    assert head.root == repo.store(table(spark, two)) and content(repo.branch("main")) == Counter(two)
    pairs = Counter((k, x, y) for k in {k for k, _ in (Counter(one) - Counter(two)) + (Counter(two) - Counter(one))} for x, y in product(*([v for q, v in side if q == k] or [None] for side in (one, two))) if x != y)
    assert Counter((r.k, r.a_v, r.b_v) for r in repo.diff(base.commit_id, head.commit_id).collect()) == pairs
    blamed = Counter((r.k, r.v, r.commit_id == base.commit_id) for r in repo.blame("main").collect())
    assert blamed == Counter((k, v, (k, v) in one) for k, v in two)
    pos = sorted(Counter(two).elements(), key=lambda r: (r[0], hashlib.sha256(f"i{len(str(r[0]))}:{r[0]};s1:{r[1]};".encode()).hexdigest()))
    assert [tuple(repo.nth(head.root, i).first()) for i in (0, 17, len(two) - 1)] == [pos[0], pos[17], pos[-1]]
    assert repo.verify() == []

    repo.commit("side", table(spark, three), base.commit_id, "me", "side")
    repo.merge("main", "side", "me", "merge", merge.take_ours)
    changed = {k for x in (two, three) for k, _ in (Counter(one) - Counter(x)) + (Counter(x) - Counter(one))}
    sides = (table(spark, [r for r in x if r[0] in changed]) for x in (one, two, three))
    merged = content(merge.merged(merge.three_way(*sides, SPEC), SPEC, merge.take_ours)) + Counter(r for r in one if r[0] not in changed)
    assert content(repo.branch("main")) == merged and repo.verify() == []

    other = Repository(spark, f"file://{tmp_path}/other", SPEC, bits=1, file_bits=1)
    assert sync.pull(repo, other, "main") == "pulled" and content(other.branch("main")) == merged and other.verify() == []


def test_leaves_of_repeated_keys(spark):
    """Every row of a key closes; which comes first is not left to how the rows were dealt."""
    data = [(k, v) for k in range(8) for v in "abc"]
    want = [hashlib.sha256(f"i1:{k};s1:{v};".encode()).hexdigest()[:40] for k, v in data]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        leaves = chunks.leaf_chunks(table(spark, data), SPEC, 1, F.lit(True)).orderBy("chunk").collect()
        assert [r.address for r in leaves] == want
