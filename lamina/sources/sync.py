"""Replication between repositories: packs, and their application before a ref moves."""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import history
from lamina.sources.repository import Commit, Repository
from lamina.sources.shared import materialize


class Diverged(Exception):
    """Neither head is behind the other."""


@dataclass(frozen=True)
class Pack:
    """Commits, parents first, the versions that the receiver lacks, and parents that the
    sender has cut off."""

    head: str
    commits: tuple[Commit, ...]
    roots: tuple[str, ...]
    shallow: tuple[str, ...] = ()


def build_pack(repo: Repository, branch: str, haves: list[str]) -> Pack:
    """All that is behind the branch less all that is behind the haves."""
    head = repo.ref(branch)
    if head is None:
        raise ValueError(f"branch {branch} has no commit")
    table, cut = repo.commits(), repo.shallow()
    behind = [r.commit_id for r in history.ancestors(table, head).collect()]
    known: set[str] = set()
    for h in haves:
        if h in behind:
            known |= {r.commit_id for r in history.ancestors(table, h).collect()}
    rows = {c: repo.commit_of(c) for c in behind if c not in known and c not in cut}
    have_roots = {repo.commit_of(c).root for c in known - cut}
    order: list[Commit] = []
    done: set[str] = set()
    stack = [(head, False)] if head in rows else []
    while stack:
        c, ready = stack.pop()
        if c in done or c not in rows:
            continue
        if ready:
            done.add(c)
            order.append(rows[c])
        else:
            stack.append((c, True))
            stack += [(p, False) for p in rows[c].parents]
    lost = {p for c in order for p in c.parents} & cut
    return Pack(head, tuple(order), tuple(sorted({c.root for c in order} - have_roots)), tuple(sorted(lost)))


def _segments(repo: Repository) -> DataFrame | None:
    """``address, batch, seg`` of all segments a repository holds, each address once."""
    out = None
    for x in repo.files.list("roots"):
        if x.endswith(".json"):
            part = repo.segments(x[:-5]).where("batch is not null").select("address", "batch", "seg")
            out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["address"]) if out is not None else None


def missing_segments(source: Repository, root: str, known: DataFrame | None) -> DataFrame:
    """The segments below a root that are not known, found from the root down: a node whose
    address the receiver's trees have is not expanded."""
    tree = source.tree(root)
    if known is None:
        return tree.where("level = 1")
    known = known.select("address").distinct()
    height = source.root_of(root)["height"]
    wanted = tree.where(F.col("level") == height).select("address")
    for level in range(height, 0, -1):
        open_ = tree.where(F.col("level") == level).join(wanted, "address", "left_semi").join(known, "address", "left_anti")
        if level == 1:
            return open_
        wanted = materialize(open_.select(F.explode("children").alias("address")).distinct(), "wanted")
    return tree.where(F.lit(False))


def _known(repo: Repository) -> DataFrame | None:
    """Addresses of all nodes of a repository's trees."""
    out = None
    for x in repo.files.list("roots"):
        if x.endswith(".json"):
            part = repo.tree(x[:-5]).select("address")
            out = part if out is None else out.unionByName(part)
    return materialize(out.distinct(), "known") if out is not None else None


def copy_root(source: Repository, target: Repository, root: str, known: DataFrame | None = None) -> int:
    """Copy a version: the rows of segments that the target lacks (or that are not ``known``,
    for a target that need not be whole), hashed again on the way, then its tree.  How
    many segments were copied."""
    if target.has_root(root):
        return 0
    schema = source.schema(root)
    lack = materialize(missing_segments(source, root, known if known is not None else _known(target)).select("address", "batch", "seg"), "lack")
    n = lack.count()
    if lack.where("batch is null").limit(1).count():
        raise ValueError(f"version {root} is not whole")
    made = None
    if n:
        made = materialize(target._over(target._write(source._rows(lack, schema))), "copied")
        sides = [x.groupBy("address").agg(F.count(F.lit(1)).alias("__n")) for x in (lack, made)]  # where keys repeat, segments may be equal
        differ = not sides[0].join(sides[1], ["address", "__n"], "left_anti").isEmpty() or made.count() != n
        if differ:
            for b in {r.batch for r in made.select("batch").distinct().collect()}:
                target.files.delete(f"data/{b}")
                target.files.delete(f"leaves/{b}")
            raise ValueError(f"version {root} does not hash to its id")
        target.written |= {r.address for r in made.select("address").collect()}
    have = _segments(target)
    place = made.select("address", "batch", "seg").dropDuplicates(["address"]) if made is not None else None
    if have is not None:
        have = have if place is None else have.join(place.select("address"), "address", "left_anti")
        place = have if place is None else place.unionByName(have)
    tree = source.tree(root).withColumnRenamed("batch", "__b").withColumnRenamed("seg", "__s").drop("__b", "__s")
    low = tree.where("level = 1")
    low = low.join(place, "address", "left") if place is not None else low.withColumn("batch", F.lit(None).cast("string")).withColumn("seg", F.lit(None).cast("string"))
    low = materialize(low, "tree")
    if known is None and low.where("batch is null").limit(1).count():
        raise ValueError(f"version {root} is not whole")
    up = tree.where("level > 1").withColumn("batch", F.lit(None).cast("string")).withColumn("seg", F.lit(None).cast("string"))
    folder, info = f"trees/{uuid.uuid4().hex}", source.root_of(root)
    kind = target._tree_type(schema)
    low.unionByName(up).select(*kind.names).write.mode("overwrite").parquet(f"{target.path}/{folder}")
    target._add_root(root, folder, schema, info["n"], info["height"], info["segments"])
    return n


def apply_pack(pack: Pack, source: Repository, target: Repository, branch: str, expected: str | None) -> bool:
    """Copy versions, check them and the commits' chain, then move the ref."""
    cut = set(pack.shallow)
    known = {x[:-5] for x in target.files.list("commits") if x.endswith(".json")} | target.shallow() | cut
    there: set[str] = set()
    for c in pack.commits:
        lost = [p for p in c.parents if p not in known and p not in there]
        if lost:
            raise ValueError(f"commit {c.commit_id} needs {lost[0]}")
        if Commit.make(c.root, c.parents, c.author, c.message, c.ts).commit_id != c.commit_id:
            raise ValueError(f"commit {c.commit_id} does not hash to its id")
        there.add(c.commit_id)
    if pack.head not in there and not target.files.exists(f"commits/{pack.head}.json"):
        raise ValueError("the head is not in the pack")
    for root in pack.roots:
        copy_root(source, target, root)
    for c in pack.commits:
        if not target.has_root(c.root):
            raise ValueError(f"version {c.root} is missing")
        target.add_commit(c)
    for p in cut:
        if not target.files.exists(f"commits/{p}.json"):
            target.files.publish(f"shallow/{p}.json", "{}")
    return target.update_ref(branch, expected, pack.head)


def advertise(repo: Repository) -> dict[str, str]:
    """What a repository offers: its refs."""
    return repo.refs()


def _forward(source: Repository, target: Repository, branch: str) -> tuple[str | None, str]:
    """The target's head and what a fast-forward from the source would be."""
    theirs, mine = source.ref(branch), target.ref(branch)
    if theirs is None:
        raise ValueError(f"branch {branch} has no commit")
    if theirs == mine:
        return mine, "up-to-date"
    if mine is None:
        return mine, "forward"
    if history.is_ancestor(source.commits(), theirs, mine).first().reaches:
        return mine, "forward"
    if history.is_ancestor(target.commits(), mine, theirs).first().reaches:
        return mine, "ahead"
    raise Diverged(f"{mine} and {theirs}")


def pull(source: Repository, target: Repository, branch: str) -> str:
    """Fast-forward only: ``up-to-date``, ``ahead`` or ``pulled``; raises ``Diverged``."""
    mine, way = _forward(source, target, branch)
    if way != "forward":
        return way
    if not apply_pack(build_pack(source, branch, list(advertise(target).values())), source, target, branch, mine):
        raise RuntimeError("the branch moved meanwhile")
    return "pulled"


def push(source: Repository, target: Repository, branch: str) -> str:
    """Give the target what it lacks and move its ref, which must not have moved since it was
    asked: ``up-to-date``, ``pushed``, ``behind`` (the target has more) or ``rejected``."""
    offered = advertise(target)
    mine, way = _forward(source, target, branch)
    if way != "forward":
        return "behind" if way == "ahead" else way
    return "pushed" if apply_pack(build_pack(source, branch, list(offered.values())), source, target, branch, mine) else "rejected"


# packs as folders -------------------------------------------------------------

PACK = {"kind": "lamina pack", "version": 1}


def save_pack(pack: Pack, source: Repository, path: str, haves: list[str] = ()) -> None:
    """A pack in a folder of its own: a repository of the versions, without the segments that
    versions of the ``haves`` have, and ``pack.json``, published last."""
    bundle = Repository(source.spark, path, source.spec, source.bits, source.file_bits)
    known = source.spark.createDataFrame([], "address string")
    for h in haves:
        known = known.unionByName(source.tree(source.commit_of(h).root).select("address"))
    for root in pack.roots:
        copy_root(source, bundle, root, known)
    text = PACK | {"head": pack.head, "roots": pack.roots, "shallow": pack.shallow, "commits": dump_commits(list(pack.commits)), "bytes": bundle.files.size("data")}
    if not bundle.files.publish("pack.json", json.dumps(text)):
        raise ValueError(f"there is a pack at {path}")


def load_pack(like: Repository, path: str, most_bytes: int | None = None) -> tuple[Pack, Repository]:
    """The pack in a folder and the repository that ``apply_pack`` copies from.  An unknown
    kind or version, a broken or too large one is refused before any rows are read."""
    bundle = Repository(like.spark, path, like.spec, like.bits, like.file_bits)
    text = bundle.files.read("pack.json")
    if text is None:
        raise ValueError(f"no pack at {path}")
    try:
        found = json.loads(text)
        if {k: found.get(k) for k in PACK} != PACK:
            raise ValueError("not a pack of this format")
        pack = Pack(found["head"], tuple(load_commits(found["commits"])), tuple(found["roots"]), tuple(found["shallow"]))
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"broken pack: {e}") from None
    size = bundle.files.size("data")
    if size != found["bytes"]:
        raise ValueError(f"the pack has {size} bytes of rows, not {found['bytes']}")
    if most_bytes is not None and size > most_bytes:
        raise ValueError(f"the pack has {size} bytes of rows, more than {most_bytes}")
    return pack, bundle


def dump_commits(commits: list[Commit]) -> str:
    """A line for each commit: id, root, parents (``-`` for none), time, author and message
    in base64."""

    def b64(s: str) -> str:
        return base64.b64encode(s.encode()).decode() or "-"

    return "".join(f"{c.commit_id} {c.root} {','.join(c.parents) or '-'} {c.ts} {b64(c.author)} {b64(c.message)}\n" for c in commits)


def load_commits(text: str) -> list[Commit]:
    """The commits of ``dump_commits``; a broken line or a wrong id is an error."""

    def plain(s: str) -> str:
        return "" if s == "-" else base64.b64decode(s, validate=True).decode()

    out = []
    for line in text.splitlines():
        parts = line.split(" ")
        if len(parts) != 6:
            raise ValueError(f"broken commit line {line!r}")
        i, root, parents, ts, author, message = parts
        c = Commit.make(root, [] if parents == "-" else parents.split(","), plain(author), plain(message), int(ts))
        if c.commit_id != i:
            raise ValueError(f"commit {i} does not hash to its id")
        out.append(c)
    return out
