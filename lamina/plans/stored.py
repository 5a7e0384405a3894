"""Queries over tables that are stored: a repository of versions of ``orders``, chunk stores
of documents, a stream of events.  What they store goes to the shared folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import encoding as E
from lamina.operators import diff, merge
from lamina.plans import catalog as C
from lamina.plans import inputs as I
from lamina.plans.catalog import query
from lamina.sources import sync
from lamina.sources.chunkstore import ChunkStore
from lamina.sources.repository import UP_BITS, Commit, Conflict, Repository
from lamina.sources.shared import new_path

LEAF_BITS, FILE_BITS = 6, 6


class Versions:
    """Versions of ``orders`` in a repository: main goes from base to v2, two branches leave
    base; made as they are asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.repo = Repository(spark, new_path(spark, "repo"), I.ORDERS, LEAF_BITS, FILE_BITS)

    def _edit(self, branch: str, df: DataFrame, message: str) -> Commit:
        changes = diff.bag_edits(diff.bags(I.base(self.spark, self.d), df, I.ORDERS), I.ORDERS)
        return self.repo.commit_edits(branch, changes, self.repo.ref(branch), "editor", message)

    @cached_property
    def base(self) -> Commit:
        return self.repo.commit("main", I.base(self.spark, self.d), None, "loader", "base")

    @cached_property
    def v2(self) -> Commit:
        return self.base and self._edit("main", I.v2(self.spark, self.d), "v2")

    @cached_property
    def ours(self) -> Commit:
        self.repo.update_ref("ours", None, self.base.commit_id)
        return self._edit("ours", I.ours(self.spark, self.d), "ours")

    @cached_property
    def theirs(self) -> Commit:
        self.repo.update_ref("theirs", None, self.base.commit_id)
        return self._edit("theirs", I.theirs(self.spark, self.d), "theirs")


_MADE: dict[tuple[str, str], Versions] = {}


def _versions(spark: SparkSession, d: str) -> Versions:
    key = (spark.sparkContext.applicationId, d)
    if key not in _MADE or not _MADE[key].repo.files.exists(""):
        _MADE[key] = Versions(spark, d)
    return _MADE[key]


def _hash_sql(bits: int) -> str:
    return f"('0x' || substr(sha256({C._entry_sql('key')}), 1, 8))::BIGINT & {(1 << bits) - 1} = 0"


def _segments_sql(src: str) -> str:
    """Common tables ``lf`` (chunks) and ``sg`` (segments) of a version's rows."""
    back = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""k AS (SELECT key, {C._entry_sql('key', 'status', 'cents')} AS entry, coalesce(sum(CAST({_hash_sql(LEAF_BITS)} AS INTEGER)) OVER (ORDER BY key {back}), 0) AS leaf,
  coalesce(sum(CAST({_hash_sql(LEAF_BITS + FILE_BITS)} AS INTEGER)) OVER (ORDER BY key {back}), 0)::BIGINT AS seg FROM ({src})),
lf AS (SELECT seg, leaf, count(*) AS n, min(key) AS first_key, max(key) AS last_key, substr(sha256(string_agg(entry, '' ORDER BY key)), 1, 40) AS address FROM k GROUP BY seg, leaf),
sg AS (SELECT seg AS pos, sum(n)::BIGINT AS n, min(first_key) AS first_key, max(last_key) AS last_key, substr(sha256(string_agg(address || ':' || n, ';' ORDER BY leaf)), 1, 40) AS address FROM lf GROUP BY seg)"""


@query(I.V2_SQL)
def repo_head(spark, d):
    v = _versions(spark, d)
    return v.v2 and v.repo.branch("main")


@query(I.BASE_SQL)
def repo_time_travel(spark, d):
    v = _versions(spark, d)
    return v.v2 and v.repo.at(v.base.commit_id)


@query(f"WITH {_segments_sql(I.V2_SQL)}, {C._levels_sql('SELECT * FROM sg', (1 << UP_BITS) - 1, 4, 1)} SELECT address AS root FROM nodes ORDER BY level DESC LIMIT 1")
def repo_root(spark, d):
    """The root of a version made by edits is that of its content."""
    return spark.createDataFrame([(_versions(spark, d).v2.root,)], "root string")


@query(f"WITH {_segments_sql(I.V2_SQL)} SELECT pos, n, first_key, last_key, address FROM sg")
def repo_segments(spark, d):
    v = _versions(spark, d)
    s = v.repo.segments(v.v2.root)
    return s.select("pos", "n", F.col("first_key.key").alias("first_key"), F.col("last_key.key").alias("last_key"), "address")


@query(f"WITH {_segments_sql(I.V2_SQL)} SELECT n, first_key, last_key, address FROM lf")
def repo_chunks(spark, d):
    v = _versions(spark, d)
    s = v.repo.nodes(v.v2.root).where("level = 0")
    return s.select("n", F.col("first_key.key").alias("first_key"), F.col("last_key.key").alias("last_key"), "address")


@query(C.DIFF_SQL)
def diff_pruned(spark, d):
    """By the stored addresses: rows of chunks that both versions have are not joined."""
    v = _versions(spark, d)
    return v.repo.diff(v.base.commit_id, v.v2.commit_id)


_NEAR = f"SELECT key, status, cents + 1 AS cents FROM ({I.BASE_SQL}) WHERE key BETWEEN 700 AND 720"


@query(f"SELECT n.key, 'MOD' AS diff_type, b.status AS a_status, b.cents AS a_cents, n.status AS b_status, n.cents AS b_cents FROM ({_NEAR}) n JOIN ({I.BASE_SQL}) b ON b.key = n.key")
def diff_near_keys(spark, d):
    """The difference that a commit to neighbouring keys makes: few segments are read."""
    v = _versions(spark, d)
    if "near" not in v.repo.branches():
        v.repo.update_ref("near", None, v.base.commit_id)
        rows = I.base(spark, d).where(F.col("key").between(700, 720)).withColumn("cents", F.col("cents") + 1)
        v.repo.commit_edits("near", rows.withColumn("is_delete", F.lit(False)), v.base.commit_id, "editor", "near")
    return v.repo.diff(v.base.commit_id, v.repo.ref("near"))


@query(C._merged_sql("CASE WHEN NOT int_ OR our_cents >= their_cents THEN 'our' ELSE 'their' END"))
def repo_merge(spark, d):
    v = _versions(spark, d)
    if "merged" not in v.repo.branches():
        v.repo.update_ref("merged", None, v.ours.commit_id)
        v.theirs and v.repo.merge("merged", "theirs", "editor", "merge", merge.take_greatest("cents"))
    return v.repo.branch("merged")


@query(f"SELECT key, base_status, base_cents, our_status, our_cents, their_status, their_cents FROM ({C.DECIDED_SQL}) WHERE outcome = 'conflict'")
def repo_conflicts(spark, d):
    v = _versions(spark, d)
    v.ours and v.theirs
    try:
        v.repo.merge("ours", "theirs", "editor", "merge")
    except Conflict as e:
        return e.rows
    return merge.conflicts(v.repo.decide(v.ours.commit_id, v.theirs.commit_id), I.ORDERS)


def _laid(spark: SparkSession, d: str, name: str) -> DataFrame:
    v = _versions(spark, d)
    if name not in v.repo.branches():
        v.repo.update_ref(name, None, v.ours.commit_id)
        (v.repo.cherry_pick if name == "picked" else v.repo.revert)(name, v.v2.commit_id, "editor", name)
    return v.repo.branch(name)


@query(f"WITH d AS ({C.DIFF_SQL}) " + C._PICK.format(s="b", gone="DEL"))
def repo_cherry_pick(spark, d):
    return _laid(spark, d, "picked")


@query(f"WITH d AS ({C.DIFF_SQL}) " + C._PICK.format(s="a", gone="ADD"))
def repo_revert(spark, d):
    return _laid(spark, d, "undone")


@query("SELECT * FROM (VALUES (0, 'editor', 'v2'), (1, 'loader', 'base')) t(depth, author, message)")
def repo_log(spark, d):
    v = _versions(spark, d)
    return v.v2 and v.repo.log("main").select("depth", "author", "message")


@query(f"SELECT v.key, CASE WHEN b.key IS NOT NULL AND b.status = v.status AND b.cents = v.cents THEN 'base' ELSE 'v2' END AS message FROM ({I.V2_SQL}) v LEFT JOIN ({I.BASE_SQL}) b ON b.key = v.key")
def repo_blame(spark, d):
    v = _versions(spark, d)
    return v.v2 and v.repo.blame("main").join(v.repo.commits(), "commit_id").select("key", "message")


@query("SELECT * FROM (VALUES ('heads/main', 'v2'), ('heads/ours', 'ours'), ('heads/theirs', 'theirs'), ('tags/first', 'base')) t(name, message)")
def repo_refs(spark, d):
    """Branches and tags, and what they name; one that was deleted and one from nothing are not there."""
    v = _versions(spark, d)
    v.v2, v.ours, v.theirs  # noqa: B018
    if not v.repo.refs("tags/first"):
        v.repo.tag("first", v.base.commit_id)
        v.repo.create_branch("short", "main")
        v.repo.delete_ref("short", v.v2.commit_id)
        v.repo.create_branch("nothing")
    named = [(n, c) for n, c in v.repo.refs().items() if n in ("heads/main", "heads/ours", "heads/theirs", "heads/short", "heads/nothing", "tags/first")]
    return spark.createDataFrame(named, "name string, commit_id string").join(v.repo.commits(), "commit_id").select("name", "message")


@query(f"SELECT * FROM ({I.V2_SQL}) WHERE key = 775")
def repo_get(spark, d):
    v = _versions(spark, d)
    return v.repo.get(v.v2.root, 775)


@query(f"SELECT * FROM ({I.V2_SQL}) ORDER BY key LIMIT 1 OFFSET 1234")
def repo_nth(spark, d):
    v = _versions(spark, d)
    return v.repo.nth(v.v2.root, 1234)


@query(f"SELECT 2 AS kept, 1 AS swept, count(*) AS rows_left FROM ({I.V2_SQL})")
def repo_gc(spark, d):
    """A version that only a deleted branch named is swept; a tagged one stays."""
    repo = Repository(spark, new_path(spark, "repo"), I.ORDERS, LEAF_BITS, FILE_BITS)
    a = repo.commit("main", I.base(spark, d), None, "loader", "base")
    repo.tag("first", a.commit_id)
    repo.commit("main", I.v2(spark, d), a.commit_id, "editor", "v2")
    lone = repo.commit("lone", I.ours(spark, d), None, "editor", "lone")
    repo.delete_ref("lone", lone.commit_id)
    kept, swept = repo.gc()
    return repo.branch("main").agg(F.lit(kept).alias("kept"), F.lit(swept).alias("swept"), F.count(F.lit(1)).alias("rows_left"))


@query(f"SELECT key, status, cents, 'pulled' AS way FROM ({I.V2_SQL})")
def repo_pull(spark, d):
    v = _versions(spark, d)
    other = Repository(spark, new_path(spark, "clone"), I.ORDERS, LEAF_BITS, FILE_BITS)
    way = v.v2 and sync.pull(v.repo, other, "main")
    return other.branch("main").withColumn("way", F.lit(way))


@query(f"SELECT key, status, cents FROM ({I.V2_SQL})")
def repo_push(spark, d):
    """A clone that edits and pushes; the other side then has its head."""
    v = _versions(spark, d)
    one, two = (Repository(spark, new_path(spark, "clone"), I.ORDERS, LEAF_BITS, FILE_BITS) for _ in range(2))
    sync.apply_pack(sync.Pack(v.base.commit_id, (v.base,), (v.base.root,)), v.repo, one, "main", None)
    sync.pull(one, two, "main")
    changes = diff.bag_edits(diff.bags(I.base(spark, d), I.v2(spark, d), I.ORDERS), I.ORDERS)
    two.commit_edits("main", changes, two.ref("main"), "editor", "v2")
    if sync.push(two, one, "main") != "pushed":
        raise RuntimeError("the push was refused")
    return one.branch("main")


@query(I.V2_SQL)
def repo_pack(spark, d):
    """A pack of what came after base, written to a folder, read and applied elsewhere."""
    v = _versions(spark, d)
    v.v2  # noqa: B018
    other, folder = Repository(spark, new_path(spark, "clone"), I.ORDERS, LEAF_BITS, FILE_BITS), new_path(spark, "pack")
    sync.apply_pack(sync.Pack(v.base.commit_id, (v.base,), (v.base.root,)), v.repo, other, "main", None)
    sync.save_pack(sync.build_pack(v.repo, "main", [v.base.commit_id]), v.repo, folder, [v.base.commit_id])
    pack, bundle = sync.load_pack(other, folder)
    sync.apply_pack(pack, bundle, other, "main", v.base.commit_id)
    return other.branch("main")


@query("SELECT 0 AS good, 1 AS broken")
def repo_verify(spark, d):
    """Problems found in a repository, before and after a row of a segment is changed."""
    repo = Repository(spark, new_path(spark, "repo"), I.ORDERS, LEAF_BITS, FILE_BITS)
    a = repo.commit("main", I.base(spark, d), None, "loader", "base")
    good = len(repo.verify())
    seg = repo.segments(a.root).orderBy("pos").first()
    folder = f"{repo.path}/data/{seg.batch}/__seg={seg.seg}"
    rows = spark.read.parquet(folder)
    bad = spark.createDataFrame(rows.withColumn("cents", F.col("cents") + 1).collect(), rows.schema)
    bad.coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.createDataFrame([(good, len(repo.verify()))], "good int, broken int")


_CHAIN = f"{C._LOG}, c AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS no FROM (SELECT DISTINCT day FROM log) ORDER BY day LIMIT 4), u AS (SELECT c.no, count(DISTINCT user_id) AS users FROM c JOIN log ON log.day <= c.day GROUP BY c.no)"


@query(f"{_CHAIN} SELECT 'day ' || min(no) AS first_bad FROM u WHERE 2 * users >= (SELECT max(users) FROM u) AND no > 0")
def repo_bisect(spark, d):
    """In a history of four days of puts, the first version with half of the last one's users."""
    repo = Repository(spark, new_path(spark, "repo"), I.USERS, 3, 2)
    log = I.log(spark, d)
    days = [r.day for r in log.select("day").distinct().orderBy("day").limit(4).collect()]
    first = None
    for i, day in enumerate(days):
        puts = log.where(F.col("day") == day).withColumn("is_delete", F.lit(False))
        made = repo.commit_edits("main", puts, repo.ref("main"), "loader", f"day {i}", order="seq")
        first = first or made
    whole = repo.branch("main").count()
    found = repo.bisect(first.commit_id, repo.ref("main"), lambda c: 2 * repo.snapshot(c.root).count() >= whole)
    return repo.commits().where(F.col("commit_id") == found).select(F.col("message").alias("first_bad"))


@query(f"{C._LOG} {C._as_of_sql('true')}")
def stream_commits(spark, d):
    """Events as a stream of edits into a branch, then the branch's table."""
    from lamina.streaming.ingest import commit_batches

    repo = Repository(spark, new_path(spark, "repo"), I.USERS, 4, 2)
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(kind).parquet(f"{d}/events.parquet*")
    edits = I.as_log(events)
    commit_batches(edits, repo, "main", new_path(spark, "stream")).awaitTermination()
    return repo.branch("main").select("user_id", "value")


# chunk stores --------------------------------------------------------------------

_TEXTS = "(SELECT doc_id, text, substr(sha256(text), 1, 40) AS hash FROM documents WHERE text IS NOT NULL)"


def _store(spark: SparkSession, d: str) -> ChunkStore:
    store = ChunkStore(spark, new_path(spark, "store"))
    store.write(spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.lit(0).alias("level"), F.col("text").alias("data")))
    return store


@query(f"SELECT hash, octet_length(encode(text)) AS size FROM {_TEXTS} WHERE doc_id = (SELECT min(doc_id) FROM {_TEXTS})")
def store_lookup(spark, d):
    store = _store(spark, d)
    first = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").agg(F.min_by(E.address("text"), "doc_id")).first()[0]
    return store.read(first).select("hash", F.octet_length("data").cast("long").alias("size"))


@query(f"SELECT DISTINCT hash FROM {_TEXTS} WHERE doc_id % 3 = 0")
def store_gc(spark, d):
    """Chunks that are left when only some are claimed."""
    store = _store(spark, d)
    claim = spark.read.parquet(f"{d}/documents.parquet").where("text is not null and doc_id % 3 = 0").select(E.address("text").alias("hash"))
    store.rewrite(claim)
    return store.hashes()


@query(f"SELECT count(DISTINCT hash) AS copied, (SELECT count(DISTINCT hash) FROM {_TEXTS}) AS chunks FROM {_TEXTS} WHERE hash NOT IN (SELECT hash FROM {_TEXTS} WHERE doc_id % 2 = 0)")
def store_pull(spark, d):
    """A store that has the even documents pulls what it lacks."""
    remote, mine = _store(spark, d), ChunkStore(spark, new_path(spark, "store"))
    mine.add(remote.all().join(spark.read.parquet(f"{d}/documents.parquet").where("text is not null and doc_id % 2 = 0").select(E.address("text").alias("hash")).distinct(), "hash", "left_semi"))
    n = mine.pull(remote)
    return mine.stats().select(F.lit(n).cast("long").alias("copied"), "chunks")

