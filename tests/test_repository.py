import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from lamina.model import TableSpec
from lamina.operators import diff, merge
from lamina.sources import sync
from lamina.sources.chunkstore import ChunkStore, MemoryStore, SnapshotCache
from lamina.sources.doubles import FailingFiles, Injected, SlowFiles
from lamina.sources.files import Files
from lamina.sources.registry import Registry, Warehouse
from lamina.sources.repository import Conflict, Repository, valid_name

SPEC = TableSpec(("k",), ("v",))


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), "k long, v string")


def content(df):
    return {r.k: r.v for r in df.collect()}


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, f"file://{tmp_path}/repo", SPEC, bits=3)


def put(repo, branch, rows, message="m", ts=None):
    return repo.commit(branch, table(repo.spark, rows), repo.ref(branch), "me", message, ts=ts)


def test_commit_and_travel(repo):
    a = put(repo, "main", {1: "a", 2: "b"})
    b = put(repo, "main", {1: "a", 2: "c", 3: "d"})
    assert content(repo.at(a.commit_id)) == {1: "a", 2: "b"} and content(repo.branch("main")) == {1: "a", 2: "c", 3: "d"}
    assert b.parents == (a.commit_id,)
    assert repo.commit("main", table(repo.spark, {9: "x"}), a.commit_id, "me", "late") is None
    assert sorted(r.diff_type for r in repo.diff(a.commit_id, b.commit_id).collect()) == ["ADD", "MOD"]
    same = put(repo, "other", {2: "b", 1: "a"})
    assert same.root == a.root and repo.diff(a.commit_id, same.commit_id).count() == 0
    assert repo.verify() == []
    assert [r.commit_id for r in repo.log("main").orderBy("depth").collect()] == [b.commit_id, a.commit_id]


def test_duplicate_keys_are_refused(repo):
    with pytest.raises(ValueError):
        repo.store(repo.spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string"))


def test_branches_and_refs(repo):
    a = put(repo, "main", {1: "a"})
    assert repo.create_branch("side", "main") and not repo.create_branch("side", "main")
    assert repo.create_branch("none") and repo.branches() == ["main", "side"]
    assert repo.tag("v1", a.commit_id) and repo.refs("tags/") == {"tags/v1": a.commit_id}
    assert not repo.update_ref("side", "wrong", "x")
    assert repo.delete_ref("side", a.commit_id) and repo.branches() == ["main"]


def test_merge_and_conflict(repo):
    put(repo, "main", {1: "a", 2: "b", 3: "c"})
    repo.create_branch("side", "main")
    put(repo, "main", {1: "A", 2: "b", 3: "c"})
    put(repo, "side", {1: "a", 2: "b", 4: "d"})
    m = repo.merge("main", "side", "me", "merge")
    assert len(m.parents) == 2 and content(repo.branch("main")) == {1: "A", 2: "b", 4: "d"}
    put(repo, "side", {1: "z", 2: "b", 4: "d"})
    with pytest.raises(Conflict) as e:
        repo.merge("main", "side", "me", "merge")
    assert [tuple(r) for r in e.value.rows.collect()] == [(1, "a", "A", "z")]
    assert repo.merge("main", "side", "me", "merge", merge.take_theirs) is not None
    assert content(repo.branch("main"))[1] == "z"
    with pytest.raises(ValueError):
        repo.merge("main", "nowhere", "me", "merge")


def test_criss_cross(repo):
    put(repo, "a", {0: "0", 1: "0"}, ts=1)
    repo.create_branch("b", "a")
    put(repo, "a", {0: "1", 1: "0"}, ts=2)
    put(repo, "b", {0: "2", 1: "0"}, ts=3)
    ha, hb = repo.ref("a"), repo.ref("b")
    repo.commit("a", table(repo.spark, {0: "1", 1: "0"}), ha, "me", "ours", [ha, hb], ts=4)
    repo.commit("b", table(repo.spark, {0: "2", 1: "0"}), hb, "me", "theirs", [hb, ha], ts=5)
    with pytest.raises(Conflict):
        repo.merge("a", "b", "me", "again")


def test_cherry_pick_and_revert(repo):
    put(repo, "main", {1: "a", 2: "b"})
    c = put(repo, "main", {1: "a", 2: "c", 3: "d"})
    put(repo, "side", {2: "x", 9: "y"})
    repo.cherry_pick("side", c.commit_id, "me", "pick")
    assert content(repo.branch("side")) == {2: "c", 3: "d", 9: "y"}
    repo.revert("main", c.commit_id, "me", "undo")
    assert content(repo.branch("main")) == {1: "a", 2: "b"}
    with pytest.raises(ValueError):
        repo.cherry_pick("main", repo.commit_of(c.commit_id).parents[0], "me", "x")


def test_blame_and_bisect(repo):
    c = [put(repo, "main", rows, f"m{i}") for i, rows in enumerate([{1: "a", 2: "x"}, {1: "b", 2: "x"}, {1: "a", 2: "x"}, {1: "a", 2: "x", 3: "n"}])]
    assert {r.k: r.commit_id for r in repo.blame("main").collect()} == {1: c[2].commit_id, 2: c[0].commit_id, 3: c[3].commit_id}
    asked = []

    def bad(commit):
        asked.append(commit)
        return content(repo.snapshot(commit.root))[1] == "a" and commit.message != "m0"

    assert repo.bisect(c[0].commit_id, c[3].commit_id, bad) == c[2].commit_id and len(asked) <= 2


def test_gc(repo):
    put(repo, "main", {1: "a"})
    lone = put(repo, "side", {7: "q"})
    repo.tag("keep", lone.commit_id)
    repo.delete_ref("side", lone.commit_id)
    assert repo.gc() == (2, 0)
    assert repo.gc(heads_only=True) == (1, 1)
    assert content(repo.branch("main")) == {1: "a"}


def test_sync(spark, repo, tmp_path):
    other = Repository(spark, f"file://{tmp_path}/other", SPEC, bits=3)
    put(repo, "main", {1: "a"})
    put(repo, "main", {1: "b"})
    assert sync.pull(repo, other, "main") == "pulled" and content(other.branch("main")) == {1: "b"}
    assert sync.pull(repo, other, "main") == "up-to-date"
    put(other, "main", {1: "c"})
    assert sync.pull(repo, other, "main") == "ahead"
    assert sync.push(repo, other, "main") == "behind" and sync.push(other, repo, "main") == "pushed" and repo.ref("main") == other.ref("main")
    put(repo, "main", {1: "d"})
    put(other, "main", {1: "e"})
    with pytest.raises(sync.Diverged):
        sync.pull(repo, other, "main")
    commits = [repo.commit_of(r.commit_id) for r in repo.commits().select("commit_id").collect()]
    assert sync.load_commits(sync.dump_commits(commits)) == commits
    with pytest.raises(ValueError):
        sync.load_commits(sync.dump_commits(commits).replace("bWU=", "eW91"))
    torn = sync.build_pack(repo, "main", [])
    with pytest.raises(ValueError):
        sync.apply_pack(sync.Pack(torn.head, torn.commits[1:], torn.roots), repo, Repository(spark, f"file://{tmp_path}/third", SPEC, bits=3), "main", None)


def test_chunk_store(spark, tmp_path):
    a, b = (ChunkStore(spark, f"file://{tmp_path}/{n}") for n in "ab")
    rows = spark.createDataFrame([(0, "x"), (0, "y"), (0, "x")], "level int, data string")
    keys = a.write(rows)
    a.write(rows)
    assert a.all().count() == 2 and keys.count() == 2
    assert b.pull(a) == 2 and b.pull(a) == 0
    a.rewrite(keys.limit(1))
    assert a.all().count() == 1 and a.verified().count() == 1 and a.stats().first().bytes == 1
    one = b.hashes().first().hash
    assert b.read(one).count() == 1 and b.read("0" * 40).count() == 0
    bad = b.all().withColumn("data", F.lit("zz"))
    from lamina.operators import integrity

    with pytest.raises(Exception, match="corrupt"):
        integrity.checked(bad).count()


def test_registry():
    opened = []
    r = Registry(lambda n: opened.append(n) or n, capacity=1)
    for n in ("a", "b"):
        r.register(n)
    with pytest.raises(ValueError):
        r.register("No Good")
    r.resolve("a"), r.resolve("a"), r.resolve("b"), r.resolve("a")
    assert opened == ["a", "b", "a"] and r.names() == ["a", "b"]
    with r.pinned("a"):
        r.resolve("b")
        r.resolve("a")
    assert opened == ["a", "b", "a", "b"]
    assert r.unregister("a") and not r.unregister("a")
    with pytest.raises(KeyError):
        r.resolve("a")


def test_names():
    assert valid_name("a-1") and not valid_name("1a") and not valid_name("a" * 64)


def test_stream_commits(spark, repo, tmp_path):
    from lamina.streaming.ingest import commit_batches

    schema = "k long, v string, is_delete boolean, seq long"
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a", False, 1), (2, "b", False, 2), (1, "c", False, 3)], schema).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    commit_batches(stream(), repo, "main", f"file://{tmp_path}/cp").awaitTermination()
    assert content(repo.branch("main")) == {1: "c", 2: "b"}
    # a second stream, with its own checkpoint, has its own batch 0
    other = f"file://{tmp_path}/in2"
    spark.createDataFrame([(7, "z", False, 1)], schema).coalesce(1).write.parquet(other)
    commit_batches(spark.readStream.schema(schema).parquet(other), repo, "main", f"file://{tmp_path}/cp2").awaitTermination()
    assert content(repo.branch("main")) == {1: "c", 2: "b", 7: "z"}
    # a commit on top does not hide a batch from its replay
    put(repo, "main", {1: "own", 2: "b", 7: "z"})
    shutil.rmtree(tmp_path / "cp" / "commits")
    commit_batches(stream(), repo, "main", f"file://{tmp_path}/cp").awaitTermination()
    assert content(repo.branch("main")) == {1: "own", 2: "b", 7: "z"}
    spark.createDataFrame([(2, None, True, 4)], schema).coalesce(1).write.mode("append").parquet(src)
    commit_batches(stream(), repo, "main", f"file://{tmp_path}/cp").awaitTermination()
    assert content(repo.branch("main")) == {1: "own", 7: "z"} and repo.log("main").count() == 4


def test_race_and_retention(repo):
    put(repo, "main", {1: "a"})
    lost = []

    def change(df):
        if not lost:
            lost.append(put(repo, "main", {1: "b"}))  # another writer comes first
        return df.withColumn("k", F.col("k") + 1)

    repo.update("main", change, "me", "mine")
    assert content(repo.branch("main")) == {2: "b"}
    assert repo.stats().count() == 3
    assert repo.gc(last=1) == (1, 2) and content(repo.branch("main")) == {2: "b"}
    assert len(repo.shallow()) == 1 and repo.verify() == []


def test_one_writer_wins(spark, tmp_path):
    """Eight writers, two hundred rounds of compare-and-set: one winner in each, no version lost."""
    files = Files(spark, f"file://{tmp_path}/refs")
    repos = [Repository(spark, f"file://{tmp_path}/refs", SPEC) for _ in range(8)]
    now = None
    for turn in range(200):
        won, gate = [], threading.Barrier(len(repos))

        def write(i):
            gate.wait()
            if repos[i].update_ref("main", now, f"{turn}-{i}"):  # noqa: B023
                won.append(f"{turn}-{i}")  # noqa: B023

        threads = [threading.Thread(target=write, args=(i,)) for i in range(len(repos))]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and repos[0].ref("main") == won[0]
        now = won[0]
    assert len([x for x in files.list("refs") if x.endswith(".json")]) == 200 and not any(x.endswith(".tmp") for x in files.list("refs"))


def test_publication_beyond_local_files(spark, tmp_path):
    """The way by a rename that does not overwrite, which other file systems take."""
    files = Files(spark, f"file://{tmp_path}/x")
    files.local = False
    assert files.publish("a/b.json", "one") and not files.publish("a/b.json", "two") and files.read("a/b.json") == "one"


def test_failures_leave_a_readable_branch(spark, tmp_path):
    """A commit that dies at any step leaves the branch at the old or the new version, and
    the next one succeeds."""
    path = f"file://{tmp_path}/repo"
    plain = Repository(spark, path, SPEC, bits=3)
    put(plain, "main", {1: "a"})
    count = FailingFiles(spark, path)
    put(Repository(spark, path, SPEC, bits=3, files=count), "main", {1: "n0"})
    steps = count.seen
    assert steps > 8
    for n in range(0, steps, 3):
        before = content(plain.branch("main"))
        bad = FailingFiles(spark, path, after=n)
        with pytest.raises(Injected):
            put(Repository(spark, path, SPEC, bits=3, files=bad), "main", {1: f"n{n + 1}"})
        assert content(plain.branch("main")) in (before, {1: f"n{n + 1}"})
    put(plain, "main", {2: "b"})
    assert content(plain.branch("main")) == {2: "b"} and plain.verify() == []
    slow = SlowFiles(spark, path, 0.001)
    assert content(Repository(spark, path, SPEC, bits=3, files=slow).branch("main")) == {2: "b"} and slow.calls > 2


KEYS = {
    "string": ("s", [f"key {i}" for i in range(300)]),
    "binary": ("x", [bytearray(i.to_bytes(2, "big")) for i in range(300)]),
    "double": ("d", [i / 8 - 9 for i in range(300)]),
    "long": ("l", [i << 32 for i in range(300)]),
}


@pytest.mark.parametrize("kind", sorted(KEYS))
def test_keys_of_all_types(spark, tmp_path, kind):
    name, keys = KEYS[kind]
    repo = Repository(spark, f"file://{tmp_path}/r", TableSpec((name,), ("v",)), bits=3, file_bits=2)
    schema = f"{name} {kind}, v int"
    a = repo.commit("main", spark.createDataFrame([(k, i) for i, k in enumerate(keys)], schema), None, "me", "all")
    assert repo.segments(a.root).count() > 3
    edits = spark.createDataFrame([(keys[7], -1, False), (keys[200], None, True)], schema + ", is_delete boolean")
    b = repo.commit_edits("main", edits, a.commit_id, "me", "edit")
    rows = {bytes(r[0]) if kind == "binary" else r[0]: r.v for r in repo.at(b.commit_id).collect()}
    want = {bytes(k) if kind == "binary" else k: i for i, k in enumerate(keys)}
    want[bytes(keys[7]) if kind == "binary" else keys[7]] = -1
    want.pop(bytes(keys[200]) if kind == "binary" else keys[200])
    assert rows == want and repo.verify() == []
    whole = spark.createDataFrame([(bytearray(k) if kind == "binary" else k, i) for k, i in want.items()], schema)
    assert repo.store(whole) == b.root  # the same version whichever way it was made
    assert sorted(r.diff_type for r in repo.diff(a.commit_id, b.commit_id).collect()) == ["DEL", "MOD"]


def test_composite_and_null_keys(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/r", TableSpec(("a", "b"), ("v",)), bits=2, file_bits=1)
    rows = [(a, b, f"{a}{b}") for a in (None, 1, 2, 3) for b in (None, *range(40))]
    schema = "a int, b long, v string"
    first = repo.commit("main", spark.createDataFrame(rows, schema), None, "me", "all")
    edits = spark.createDataFrame([(None, None, None, True), (None, 5, "new", False), (9, None, "new", False)], schema + ", is_delete boolean")
    second = repo.commit_edits("main", edits, first.commit_id, "me", "edit")
    want = {(a, b): v for a, b, v in rows} | {(None, 5): "new", (9, None): "new"}
    want.pop((None, None))
    assert {(r.a, r.b): r.v for r in repo.at(second.commit_id).collect()} == want
    assert repo.store(spark.createDataFrame([(*k, v) for k, v in want.items()], schema)) == second.root
    assert [r.v for r in repo.get(second.root, (2, 7)).collect()] == ["27"]
    assert [(r.a, r.b) for r in repo.nth(second.root, 1).collect()] == [(None, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_edits_make_the_same_version(spark, tmp_path, seed):
    """Commits of random edits against storing the whole table."""
    rng = random.Random(seed)
    repo = Repository(spark, f"file://{tmp_path}/r", SPEC, bits=2, file_bits=1)
    now = {k: "0" for k in rng.sample(range(400), 150)}
    put(repo, "main", now)
    for turn in range(3):
        edits = {}
        for k in rng.sample(range(420), rng.choice([1, 10, 150])):
            edits[k] = None if rng.random() < 0.5 else str(turn)
        df = spark.createDataFrame([(k, v, v is None) for k, v in edits.items()], "k long, v string, is_delete boolean")
        made = repo.commit_edits("main", df, repo.ref("main"), "me", str(turn))
        now = {k: v for k, v in (now | edits).items() if v is not None}
        assert content(repo.branch("main")) == now
        assert repo.store(table(spark, now)) == made.root
    assert repo.verify() == []


def test_a_small_commit_touches_few_segments(spark, tmp_path):
    """What one edited key reads and writes does not grow with the table."""
    seen = {}
    for n in (500, 4000):
        repo = Repository(spark, f"file://{tmp_path}/r{n}", SPEC, bits=3, file_bits=3)
        a = repo.commit("main", spark.range(n).selectExpr("id AS k", "'v' AS v"), None, "me", "all")
        repo.read, repo.written = set(), set()
        files = len([x for x in repo.files.list("data") if x.endswith(".parquet")])
        b = repo.commit_edits("main", spark.createDataFrame([(n // 2, "w", False)], "k long, v string, is_delete boolean"), a.commit_id, "me", "one")
        more = len([x for x in repo.files.list("data") if x.endswith(".parquet")]) - files
        wrote = (len(repo.read), len(repo.written), more)
        repo.read = set()
        assert [tuple(r) for r in repo.diff(a.commit_id, b.commit_id).collect()] == [(n // 2, "MOD", "v", "w")]
        seen[n] = (*wrote, len(repo.read))
        assert repo.segments(a.root).count() >= n / 200
    assert seen[4000] == (1, 1, 1, 2) and seen[500] == (1, 1, 1, 2)


def test_merge_reads_changes_only(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/r", SPEC, bits=3, file_bits=2)
    base = {k: "0" for k in range(1500)}
    put(repo, "main", base)
    repo.create_branch("side", "main")
    put(repo, "main", base | {10: "m", 20: "x"})
    put(repo, "side", base | {1400: "s", 20: "y"})
    repo.read = set()
    with pytest.raises(Conflict) as e:
        repo.merge("main", "side", "me", "merge")
    assert [tuple(r) for r in e.value.rows.collect()] == [(20, "0", "x", "y")]
    assert len(repo.read) <= 8
    picks = spark.createDataFrame([(20, "value", "mine"), (10, "theirs", None)], "k long, choice string, v string")
    assert repo.merge("main", "side", "me", "merge", resolutions=picks) is not None
    assert content(repo.branch("main")) == base | {10: "m", 1400: "s", 20: "mine"}
    repo.read = set()
    repo.create_branch("late", "main")
    put(repo, "late", base)
    repo.read = set()
    made = repo.merge("main", "late", "me", "forward")
    assert not repo.read and made.root == repo.commit_of(repo.ref("late")).root and len(made.parents) == 2


def test_both_formulations_of_a_merge(spark):
    rng = random.Random(4)
    base = {k: rng.choice("ab") for k in range(60)}
    sides = []
    for _ in range(2):
        sides.append({k: rng.choice("abc") for k in range(80) if rng.random() < 0.7} | {k: v for k, v in base.items() if rng.random() < 0.4})
    b, o, t = (table(spark, x) for x in (base, *sides))
    whole = merge.three_way(b, o, t, SPEC).where("outcome <> 'same'")
    by_diffs = merge.from_diffs(diff.diff(b, o, SPEC), diff.diff(b, t, SPEC), SPEC)
    assert sorted(map(str, whole.collect())) == sorted(map(str, by_diffs.select(*whole.columns).collect()))
    assert {r.outcome for r in whole.collect()} == {"ours", "theirs", "both", "conflict"}


def test_packs_in_folders(spark, repo, tmp_path):
    base = {k: "0" for k in range(300)}
    a = put(repo, "main", base)
    other = Repository(spark, f"file://{tmp_path}/other", SPEC, bits=3)
    assert sync.pull(repo, other, "main") == "pulled"
    put(repo, "main", base | {5: "x"})
    pack = sync.build_pack(repo, "main", [a.commit_id])
    assert len(pack.commits) == 1 and len(pack.roots) == 1
    sync.save_pack(pack, repo, f"file://{tmp_path}/pack", [a.commit_id])
    found, bundle = sync.load_pack(other, f"file://{tmp_path}/pack")
    assert found == pack
    assert bundle.files.size("data") < repo.files.size("data") / 2  # one segment, not the table
    with pytest.raises(ValueError, match="needs"):
        sync.apply_pack(found, bundle, Repository(spark, f"file://{tmp_path}/third", SPEC, bits=3), "main", None)
    assert sync.apply_pack(found, bundle, other, "main", a.commit_id)
    assert content(other.branch("main")) == base | {5: "x"} and other.verify() == []
    with pytest.raises(ValueError, match="more than"):
        sync.load_pack(other, f"file://{tmp_path}/pack", most_bytes=1)
    (tmp_path / "pack" / "pack.json").write_text('{"kind": "else"}')
    with pytest.raises(ValueError):
        sync.load_pack(other, f"file://{tmp_path}/pack")
    with pytest.raises(ValueError, match="no pack"):
        sync.load_pack(other, f"file://{tmp_path}/nothing")


def test_broken_rows_are_found(spark, repo, tmp_path):
    a = put(repo, "main", {k: "0" for k in range(50)})
    seg = repo.segments(a.root).first()
    folder = f"{repo.path}/data/{seg.batch}/__seg={seg.seg}"
    rows = spark.read.parquet(folder).withColumn("v", F.lit("bad")).collect()
    spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(folder)
    assert repo.verify() == [f"mismatch {a.root}"]
    with pytest.raises(ValueError, match="does not hash"):
        sync.pull(repo, Repository(spark, f"file://{tmp_path}/o", SPEC, bits=3), "main")


def test_shallow_history_travels(spark, repo, tmp_path):
    for i in range(3):
        put(repo, "main", {1: str(i)}, f"m{i}")
    assert repo.gc(last=1) == (1, 2)
    other = Repository(spark, f"file://{tmp_path}/o", SPEC, bits=3)
    assert sync.pull(repo, other, "main") == "pulled" and content(other.branch("main")) == {1: "2"} and len(other.shallow()) == 1


def test_long_chain(spark):
    from lamina.operators import integrity

    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(66)], "parent string, child string")
    assert integrity.reachable(edges, spark.createDataFrame([("0",)], "hash string")).count() == 67


def test_store_in_batches(spark, tmp_path):
    from lamina.operators import integrity

    s = ChunkStore(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame([(0, t) for t in x], "level int, data string")
    with s.batch():
        s.write(rows("a", "b"))
        s.write(rows("b", "c"))
        assert s.size() == 0
    assert s.size() == 3 and s.written == 3
    with pytest.raises(RuntimeError), s.batch():
        s.write(rows("d"))
        raise RuntimeError
    assert s.size() == 3
    one = s.hashes().orderBy("hash").first().hash
    assert s.read(one).count() == 1 and s.delete(one) and not s.delete(one) and s.size() == 2
    with pytest.raises(ValueError):
        ChunkStore(spark, f"file://{tmp_path}/s", "sha512")
    remote = ChunkStore(spark, f"file://{tmp_path}/r")
    names = [r.hash for r in remote.write(rows("root", "x", "y", "lone")).orderBy("hash").collect()]
    by = {r.data: r.hash for r in remote.all().collect()}
    edges = spark.createDataFrame([(by["root"], by["x"]), (by["x"], by["y"])], "parent string, child string")
    assert len(names) == 4 and s.pull(remote, edges, by["root"]) == 3 and s.size() == 5
    assert s.pull(remote, edges, by["root"]) == 0
    assert integrity.unknown_below(edges, by["root"], remote.hashes()).count() == 0
    s.clear()
    assert s.size() == 0
    m = MemoryStore(spark)
    m.write(rows("a", "a", "b"))
    assert m.size() == 2 and m.read(m.all().first().hash).count() == 1
    m.clear()
    assert m.size() == 0


def test_cache(spark):
    loads = []
    cache = SnapshotCache(lambda n: loads.append(n) or spark.range(50).withColumn("x", F.lit(n)), 10_000_000)
    cache.get("a"), cache.get("a"), cache.get("b")
    assert loads == ["a", "b"] and (cache.hits, cache.misses) == (1, 2) and cache.bytes > 0
    cache.most = 1
    cache.get("c")
    assert cache.bytes > 0 or loads[-1] == "c"


def test_quiesce_and_warehouse(spark, tmp_path):
    r = Registry(lambda n: n)
    r.register("a")
    with r.pinned("a"):
        assert not r.quiesce("a", 0.05)
        with pytest.raises(RuntimeError):
            r.unregister("a")
    assert r.quiesce("a", 1) and r.names() == []
    w = Warehouse(spark, f"file://{tmp_path}/w", lambda n: SPEC)
    put(w.create("one"), "main", {1: "a"})
    again = Warehouse(spark, f"file://{tmp_path}/w", lambda n: SPEC)
    assert content(again.open("one").branch("main")) == {1: "a"} and again.sizes()["one"] > 0


def test_observed(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/s")
    before = s.hashes()
    s.write(spark.createDataFrame([(0, "abc"), (0, "de")], "level int, data string"))
    df, seen = s.observed("reads")
    assert df.count() == 2 and seen.get["chunks"] == 2
    assert s.added(before).count() == 2


def test_empty_versions(spark, repo, tmp_path):
    none = table(spark, {1: "a"}).where("false")
    a = repo.commit("main", none, None, "me", "nothing")
    assert content(repo.branch("main")) == {} and repo.verify() == []
    b = put(repo, "main", {1: "a", 2: "b"})
    gone = spark.createDataFrame([(1, None, True), (2, None, True), (5, None, True)], "k long, v string, is_delete boolean")
    c = repo.commit_edits("main", gone, b.commit_id, "me", "all gone")
    assert c.root == a.root and content(repo.branch("main")) == {}
    assert repo.diff(b.commit_id, c.commit_id).count() == 2
    assert sync.pull(repo, Repository(spark, f"file://{tmp_path}/o", SPEC, bits=3), "main") == "pulled"
    assert repo.nth(a.root, 0).count() == 0 and repo.get(a.root, 1).count() == 0
    same = repo.commit_edits("main", gone.where("false"), c.commit_id, "me", "no edits")
    assert same.root == c.root


def test_small_segments_share_folders(spark, tmp_path):
    """Folders grow with rows, not with segments; a folder that also holds what is stored already is written anew."""
    repo = Repository(spark, f"file://{tmp_path}/r", SPEC, bits=2, file_bits=1)
    base = {k: "0" for k in range(3000)}
    a = put(repo, "main", base)
    found = repo.segments(a.root).collect()
    assert len(found) > 200 and len(repo.files.folders(f"data/{found[0].batch}")) <= 8
    assert tuple(repo.get(a.root, 1500).first()) == (1500, "0") and tuple(repo.nth(a.root, 2000).first()) == (2000, "0")
    edits = spark.createDataFrame([(k, "1", k % 2 == 0) for k in range(0, 3000, 10)], "k long, v string, is_delete boolean")
    b = repo.commit_edits("main", edits, a.commit_id, "me", "edits")
    now = {k: "1" if k % 10 == 0 else v for k, v in base.items() if k % 20 != 0 and (k % 10 or k % 2)}
    assert content(repo.branch("main")) == now and content(repo.at(a.commit_id)) == base
    c = put(repo, "main", now | {7: "7", 1507: "7"})
    last = {r.batch for r in repo.segments(c.root).collect()} - {r.batch for r in repo.segments(b.root).collect()}
    kept = spark.read.parquet(*(f"{repo.path}/data/{x}" for x in last))
    assert kept.count() < 300 and content(repo.branch("main")) == now | {7: "7", 1507: "7"} and repo.verify() == []
    other = Repository(spark, f"file://{tmp_path}/o", SPEC, bits=2, file_bits=1)
    assert sync.pull(repo, other, "main") == "pulled" and content(other.branch("main")) == now | {7: "7", 1507: "7"}
    assert repo.gc(last=1) == (1, 2) and content(repo.branch("main")) == now | {7: "7", 1507: "7"} and repo.verify() == []
