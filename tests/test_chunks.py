import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.functions import encoding as E
from lamina.functions import fnv
from lamina.model import TableSpec
from lamina.operators import chunks, radix, sequential
from lamina.operators.ranges import Ranges, beside, numbered

SPEC = TableSpec(("k",), ("v",))


def _table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "k long, v string").repartition(parts)


def test_root_depends_on_content_only(spark):
    rows = [(k, f"v{k % 17}") for k in range(1500)]
    roots = set()
    for parts in (1, 5):
        random.shuffle(rows)
        roots.add(chunks.root_address(chunks.tree(_table(spark, rows, parts), SPEC, 4)))
    assert len(roots) == 1
    rows[3] = (rows[3][0], "other")
    assert chunks.root_address(chunks.tree(_table(spark, rows), SPEC, 4)) not in roots


def test_empty_root(spark):
    levels = chunks.tree(_table(spark, []), SPEC, 4)
    assert chunks.root_address(levels) == chunks.EMPTY_ROOT and chunks.edges(levels).count() == 0


def test_tree_counts(spark):
    levels = chunks.tree(_table(spark, [(k, "") for k in range(800)]), SPEC, 3)
    assert levels[-1].select("n").collect() == [(800,)]
    assert chunks.edges(levels).count() == sum(lv.count() for lv in levels[:-1])


def test_one_edit_changes_few_chunks(spark):
    rows = [(k, "v") for k in range(3000)]
    a = chunks.leaf_chunks(_table(spark, rows), SPEC, 5)
    b = chunks.leaf_chunks(_table(spark, [*rows[:1500], (1500, "w"), *rows[1501:]]), SPEC, 5)
    assert chunks.changed_chunks(a, b).count() == 1


def _fnv(data):
    h = fnv.OFFSET
    for b in data:
        h = ((h ^ b) * fnv.PRIME) & fnv.MASK
    return h


def _clamped(keys, bits, least, most, content):
    """The rule, a key at a time."""
    near = {k: _fnv(k.to_bytes(4, "little")) & ((1 << bits) - 1) == 0 for k in keys}
    want, chunk, held = {}, 0, []
    for k in keys:
        held.append(k)
        cut = None
        if len(held) >= least and near[k]:
            cut = len(held)
        elif most and len(held) >= most:
            cut = 1 + min(range(most), key=lambda i: (_fnv(b"h2:" + held[i].to_bytes(4, "little")), held[i])) if content else most
        if cut:
            want |= dict.fromkeys(held[:cut], chunk)
            held, chunk = held[cut:], chunk + 1
    return want | dict.fromkeys(held, chunk)


@pytest.mark.parametrize("least,most,content,ranges", [(3, 10, False, 1), (3, 10, False, 9), (3, 10, True, 9), (6, 9, True, 40), (3, None, False, 9), (5, 400, True, 7)])
def test_clamps(spark, least, most, content, ranges, monkeypatch):
    keys = sorted(random.Random(2).sample(range(100_000), 900))
    df = spark.createDataFrame([(k, "") for k in keys], "k long, v string").repartition(5)
    monkeypatch.setattr(sequential, "Ranges", lambda d, k, n=None: Ranges(d, k, ranges))
    got = chunks.clamped(df, ["k"], fnv.is_boundary("k", 3), least, most, chunks.second_hash("k") if content else None)
    assert {r.k: r.chunk for r in got.collect()} == _clamped(keys, 3, least, most, content)


def test_clamp_that_never_agrees(spark, monkeypatch):
    """Without boundaries every range waits for the one before it."""
    df = spark.range(1000).withColumnRenamed("id", "k")
    monkeypatch.setattr(sequential, "Ranges", lambda d, k, n=None: Ranges(d, k, 12))
    got = {r.k: r.chunk for r in chunks.clamped(df, ["k"], F.lit(False), 2, 7).collect()}
    assert got == {k: k // 7 for k in range(1000)}
    assert chunks.clamped(df.where("k < 0"), ["k"], F.lit(False), 2, 7).count() == 0


def _rolled(data, level, entry, table):
    """The production rule, a byte at a time."""
    salt, ends = chunks.level_salt(level), []
    size, last, crossed = 0, [], False
    for i, raw in enumerate(data):
        size += 1
        last = [*last[-66:], table[raw ^ salt]]
        if not crossed and size >= 512:
            h = 0
            for d, w in enumerate(reversed(last)):
                turn = d % 32
                h ^= (w << turn | w >> (32 - turn)) & 0xFFFFFFFF
            mask = (1 << max(0, 15 - (size >> 10))) - 1
            crossed = size >= 16384 or h & mask == mask
        if ((i + 1) % entry == 0 or i + 1 == len(data)) and crossed:
            ends.append(i + 1)
            size, last, crossed = 0, [], False
    return ends


@pytest.mark.parametrize("level,entry", [(0, 1), (1, 32), (2, 700)])
def test_rolling_rule(level, entry):
    data = chunks.counter_stream(40_000)
    ends = chunks.stream_ends(data, chunks.rolling_rule(level), entry)
    assert ends == _rolled(data, level, entry, chunks.rolling_table())
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert min(sizes) >= 512 and max(sizes) <= 15 * 1024 + entry


def test_rolling_rule_heals():
    data = chunks.counter_stream(200_000)
    assert chunks.stream_ends(data, chunks.rolling_rule()) != chunks.stream_ends(data, chunks.rolling_rule(1))
    distance, share = chunks.healing(data, 60_000, chunks.rolling_rule())
    assert distance is not None and share > 0.3
    cuts = chunks.plain_cuts(data[:20_000])
    assert cuts[0] >= 48 and 200 < len(cuts) < 450


def test_rolling_chunks_in_ranges(spark, monkeypatch):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest() * 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(4)
    found = []
    for ranges in (1, 8):
        monkeypatch.setattr(sequential, "Ranges", lambda d, k, n=None, ranges=ranges: Ranges(d, k, ranges))
        found.append({r.k: r.chunk for r in chunks.rolling_chunks(df, SPEC).collect()})
    entries = [f"i{len(str(k))}:{k};s{len(v)}:{v};".encode() for k, v in rows]
    ends = chunks.rolling_rule()(pa.table({"entry": pa.array(entries, pa.binary())}))
    want, chunk = {}, 0
    for k, _ in rows:
        want[k] = chunk
        chunk += k + 1 in set(ends)
    assert found[0] == found[1] == want and len(ends) > 20


def test_masks_by_size(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 60), rng.randrange(1 << 40)) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, size long, mix long").repartition(4)
    monkeypatch.setattr(sequential, "Ranges", lambda d, k, n=None: Ranges(d, k, 6))
    got = {r.k: r.chunk for r in chunks.masked(df, ["k"], F.col("size"), F.col("mix"), 50, 300, 900, 5, 2).collect()}
    want, chunk, size = {}, 0, 0
    for k, s, mix in rows:
        want[k], size = chunk, size + s
        if size >= 50 and (size >= 900 or mix & ((1 << (5 if size < 300 else 2)) - 1) == 0):
            chunk, size = chunk + 1, 0
    assert got == want


def test_gear_rule():
    data, table = chunks.counter_stream(30_000), chunks.rolling_table(b"gear", 64)
    ends, size, h = [], 0, 0
    for i, b in enumerate(data):
        size, h = size + 1, (h * 2 + table[b]) % (1 << 64)
        if size >= 512 and (size >= 4096 or h >> (64 - (11 if size < 1024 else 8)) == 0):
            ends.append(i + 1)
            size = h = 0
    assert chunks.stream_ends(data, chunks.gear_rule(512, 1024, 4096, 11, 8)) == ends and len(ends) > 10


def test_keys_of_all_types(spark):
    """Boundaries look at the whole key, whatever its type."""
    rows = [(f"k{i}", bytearray(str(i).encode()), i / 7, i << 32, None if i == 3 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, b binary, d double, l long, n int").repartition(3)
    for keys in (("s",), ("b",), ("d",), ("l",), ("n", "s")):
        leaves = chunks.leaf_chunks(df, TableSpec(keys, ("s",)), 4)
        assert 15 < leaves.count() < 90 and leaves.agg(F.sum("n")).first()[0] == 600
    one, text = (spark.createDataFrame([(v,)], t).select(E.entry("x").alias("e")).first().e for v, t in ((1, "x int"), ("1", "x string")))
    assert one != text


def test_numbered(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(1000)], "x double, i int").repartition(7)
    rows = sorted(numbered(df, ["x"]).collect(), key=lambda r: r.x)
    assert [r.ordinal for r in rows] == list(range(1000))


def test_beside(spark):
    rows = [(random.Random(i).random(), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, g int").repartition(5)
    want = sorted((g, x) for x, g in rows)
    got = {(r.g, r.x): (r.before, r.after) for r in beside(df, ["g", "x"], before=(F.col("x"), -1), after=(F.col("x"), 1)).collect()}
    for i, k in enumerate(want):
        assert got[k] == (want[i - 1][1] if i else None, want[i + 1][1] if i + 1 < len(want) else None)


def _plain_trie(items, at=0):
    if len(items) == 1:
        return radix.node_address(radix.leaf_bytes(items[0][0][at:], items[0][1]))
    end = at
    while all(len(k) > end and k[end] == items[0][0][end] for k, _ in items):
        end += 1
    own = next((i for k, i in items if len(k) == end), None)
    kids = sorted({k[end] for k, _ in items if len(k) > end})
    return radix.node_address(radix.inner_bytes(items[0][0][at:end], own, [(b, _plain_trie([x for x in items if len(x[0]) > end and x[0][end] == b], end + 1)) for b in kids]))


@given(st.dictionaries(st.text("ab/", max_size=6).map(str.encode), st.integers(0, 99), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_subtree(entries):
    items = sorted(entries.items())
    assert radix.subtree(items, 0, []) == _plain_trie(items)


def test_radix_build_in_parts(spark):
    entries = {f"http://a/{i % 7}/{i}".encode(): i for i in range(300)} | {b"http://a/1": 999, b"": 5}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in entries.items()], "key binary, id long")
    want = _plain_trie(sorted(entries.items()))
    for rows in (10, 1000):
        nodes, root = radix.build(df.repartition(4), part_rows=rows)
        assert root == want
        pages = radix.pages(nodes, bits=2, least=2, most=9).groupBy("page").count().collect()
        assert sum(p["count"] for p in pages) == nodes.count() and max(p["count"] for p in pages) <= 9
        back = {bytes(r.key): r.id for r in radix.entries_of(nodes).collect()}
        assert back == entries
    assert radix.lookup(df, b"http://a/1").select("id").collect() == [(999,)]


def test_radix_insert_and_changes(spark):
    def table(d):
        return spark.createDataFrame([(bytearray(k), v) for k, v in d.items()], "key binary, id long")

    old = {f"http://a/{i % 7}/{i}".encode(): i for i in range(120)}
    more = {b"http://a/3/new": 7, b"http://a/1/1": 500}
    a, _ = radix.build(table(old), part_rows=25)
    b, root = radix.build(radix.insert(table(old), table(more)), part_rows=25)
    assert root == _plain_trie(sorted((old | more).items()))
    only = radix.changed_nodes(a, b).groupBy("side").count().collect()
    assert {r.side for r in only} == {"a", "b"} and all(r["count"] < 12 for r in only)
    both = radix.stored_bytes(a.unionByName(b)).first()
    assert both.nodes < a.count() + 12 and both.bytes > radix.stored_bytes(a).first().bytes


def test_size_stats(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "n")
    got = chunks.size_stats(df).first()
    assert (got.chunks, got.mean, got.p50, got.p95, got.p99, got.smallest, got.largest) == (100, 50.5, 50, 95, 99, 1, 100)
    assert abs(got.sd - 29.011491975882016) < 1e-9
    assert df.agg(F.count("n")).first()[0] == 100
