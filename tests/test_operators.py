import random

from lamina.model import TableSpec
from lamina.operators import diff, edits, history, integrity, merge, scan

SPEC = TableSpec(("k",), ("v",))


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), "k string, v string")


def content(df):
    return {r.k: r.v for r in df.collect()}


def test_diff_with_nulls(spark):
    a, b = {None: "x", "a": None, "b": "1"}, {None: "y", "a": None, "c": ""}
    got = {r.k: (r.diff_type, r.a_v, r.b_v) for r in diff.diff(table(spark, a), table(spark, b), SPEC).collect()}
    assert got == {None: ("MOD", "x", "y"), "b": ("DEL", "1", None), "c": ("ADD", None, "")}
    assert content(diff.apply_diff(table(spark, a), diff.diff(table(spark, a), table(spark, b), SPEC), SPEC)) == b


def test_merge_laws(spark):
    rng = random.Random(4)
    for _ in range(3):
        base = {f"k{i}": rng.choice("ab") for i in range(20)}
        left = {k: v for k, v in base.items() if int(k[1:]) % 4} | {f"k{i}": "L" for i in range(0, 20, 6)}
        right = {k: v for k, v in base.items() if (int(k[1:]) - 1) % 4} | {"n": "R"}
        one = merge.three_way(*(table(spark, t) for t in (base, left, right)), SPEC)
        two = merge.three_way(*(table(spark, t) for t in (base, right, left)), SPEC)
        assert merge.conflicts(one, SPEC).count() == 0
        assert content(merge.merged(one, SPEC)) == content(merge.merged(two, SPEC))


def test_conflict_kinds(spark):
    base, ours, theirs = {"m": "0", "d": "0", "s": "0", "g": "0"}, {"m": "1", "s": "9", "n": "1"}, {"m": "2", "d": "2", "s": "9", "n": "2"}
    decided = merge.three_way(*(table(spark, t) for t in (base, ours, theirs)), SPEC)
    assert {r.k: r.outcome for r in decided.collect()} == {"m": "conflict", "d": "conflict", "s": "both", "n": "conflict", "g": "both"}
    assert content(merge.merged(decided, SPEC)) == {"m": "0", "d": "0", "s": "9"}


def test_edits(spark):
    schema = "k string, v string, is_delete boolean, seq long"
    log = spark.createDataFrame([("a", "1", False, 1), ("a", None, True, 2), ("b", "2", False, 3), ("c", "", False, 4), ("z", None, True, 5)], schema)
    small = edits.compact(log, SPEC)
    assert {r.k: (r.v, r.is_delete) for r in small.collect()} == {"a": (None, True), "b": ("2", False), "c": ("", False), "z": (None, True)}
    base = table(spark, {"a": "0", "b": "0", "q": None})
    assert content(edits.apply_edits(base, small, SPEC)) == {"b": "2", "c": "", "q": None}
    asked = spark.createDataFrame([("a",), ("b",), ("q",), ("nope",)], "k string")
    seen = {r.k: (r.found, r.v) for r in edits.overlay_get(base, small, SPEC, asked).collect()}
    assert seen == {"a": (False, None), "b": (True, "2"), "q": (True, None), "nope": (False, None)}


def test_scans_on_nothing(spark):
    none = spark.createDataFrame([], "k long, v string")
    assert scan.rank_nth(none, SPEC, 0).count() == 0 and scan.lower_bound(none, SPEC, 1).count() == 0
    assert scan.scan(none, SPEC, 1, 2, 3).count() == 0 and scan.first_last(none, SPEC).first().first_k is None


def test_frontier_walk_is_the_driver_walk(spark, monkeypatch):
    rows = [("r", []), ("a", ["r"]), ("b", ["r"]), ("a2", ["a", "b"]), ("b2", ["b", "a"]), ("m", ["a2", "b2"]), ("n", ["m"]), ("x", ["a"]), ("z", [])]
    dag = spark.createDataFrame([(c, p, i) for i, (c, p) in enumerate(rows)], "commit_id string, parents array<string>, ts long")
    want = {tuple(r) for r in history.ancestors(dag, "n").collect()}
    monkeypatch.setattr(history, "DRIVER_COMMITS", 2)
    assert {tuple(r) for r in history.ancestors(dag, "n").collect()} == want


def test_bisect_edges():
    path = list("abcdef")
    for bad in range(1, 6):
        assert history.bisect(path, lambda c, bad=bad: c >= path[bad]) == path[bad]
    assert history.bisect(path, lambda c: False) == "f"


def test_reach_and_verify(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "lost"), ("a", "b"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("r",)], "hash string")
    assert {r.hash for r in integrity.reachable(edges, roots).collect()} == {"r", "a", "b", "lost"}
    both = integrity.keep_set(edges, roots, spark.createDataFrame([("x",)], "hash string"))
    assert both.count() == 6
