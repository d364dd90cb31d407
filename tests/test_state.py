"""Algebra of the merge, and the two forms of the state."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.config import SyncConfig
from palimpsest.operators import hierarchy, maintain, match, reconcile, report, state
from palimpsest.plans import catalogue
from palimpsest.sources import readers
from palimpsest.streaming import oplog

OPS = readers.OPS


def ops(n, seed):
    r = random.Random(seed)
    return [(f"i{r.randint(0, 3)}", r.choice(["tags", "notes"]), f"k{r.randint(0, 4)}", f"u{r.randint(0, 2)}", c, r.choice("abc"), r.random() < 0.3, c) for c in r.sample(range(1000), n)]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_merge_commutes_and_is_idempotent(spark):
    a = ops(60, 1)
    b = a + random.Random(2).sample(a, 20)
    random.Random(3).shuffle(b)
    first = spark.createDataFrame(a, OPS)
    whole = rows(state.merge(first))
    assert whole == rows(state.merge(spark.createDataFrame(b, OPS)))
    halves = maintain.compact(spark.createDataFrame(a[:30], OPS)).unionByName(maintain.compact(spark.createDataFrame(a[30:], OPS)))
    assert whole == rows(state.merge(halves))


def test_stream_equals_batch(spark):
    o = spark.createDataFrame(ops(80, 4), OPS)
    assert rows(oplog.replay(spark, o).select(*state.merge(o).columns)) == rows(state.merge(o))


def test_purge_modes(spark):
    s = spark.createDataFrame([("i", "tags", "a", True, 5), ("i", "tags", "b", True, None), ("i", "tags", "c", False, None), ("i", "tags", "d", True, 50)], "identity string, section string, key string, deleted boolean, deleted_at long")
    keys = lambda d: sorted(r.key for r in d.collect())
    assert keys(maintain.purge_plan(s, 10)) == ["a", "b"]
    assert keys(maintain.purge_plan(s, 10, server=True)) == ["a"]
    assert keys(maintain.purge_plan(s, None)) == ["a", "b", "d"]


def test_jaccard_boundary(spark):
    local = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (2, "D"), (2, "E")], "local_id long, checksum string")
    remote = spark.createDataFrame([(7, "A"), (8, "C")], "remote_id long, checksum string")
    assert [(r.remote_id, r.local_id, r.score) for r in match.similar(remote, local).collect()] == [(7, 1, 0.5)]


@pytest.mark.parametrize(
    "local, remote, author, pushed, push, apply",
    [
        ("a", "a", "u1", None, "skip_equal", "skip_equal"),
        ("", None, None, None, "skip_empty", "conflict_local"),
        ("a", "b", "u1", "a", "conflict_remote", "apply"),
        ("a", "b", "u1", "x", "push", "conflict_local"),
        ("a", "b", "u1", None, "push", "conflict_local"),
        ("a", "b", "u0", "a", "push", "skip_own"),
        (None, "b", "u1", None, "push", "apply"),
    ],
)
def test_decisions(spark, local, remote, author, pushed, push, apply):
    d = spark.createDataFrame([(local, remote, author, pushed)], "l string, r string, a string, p string")
    p = F.when(F.col("p").isNotNull(), reconcile.field_hash(F.col("p")))
    args = (F.col("l"), F.col("r"), F.col("a"), p, "u0")
    r = d.select(reconcile.push_action(*args).alias("push"), reconcile.apply_action(*args).alias("apply")).first()
    assert (r.push, r.apply) == (push, apply)


def test_cycles_come_last(spark):
    n = spark.createDataFrame([("a", None, "a", 5), ("b", "a", "b", 1), ("x", "y", "x", 0), ("y", "x", "y", 2), ("o", "gone", "o", 3), ("z", "y", "z", 4)], "uuid string, parent string, name string, ordinal long")
    got = [(r.uuid, r.depth) for r in hierarchy.in_order(n).collect()]
    assert got == [("o", 0), ("a", 0), ("b", 1), ("x", -1), ("y", -1), ("z", -1)]


def test_connection_strings(spark):
    d = spark.createDataFrame([("overlay://ws/h:1/r%20x?t=1",), ("wss://h/r",), ("overlay://file//tmp/a",), ("nonsense",), (None,)], "s string")
    got = [r.c and (r.c.kind, r.c.host, r.c.port, r.c.room, r.c.path, r.c.secure) for r in d.select(readers.connection(F.col("s")).alias("c")).collect()]
    assert got == [("ws", "h", 1, "r x", None, False), ("ws", "h", None, "r", None, True), ("file", None, None, None, "/tmp/a", None), None, None]


def test_config():
    c = SyncConfig.from_options({"mode": "pull", "sync_tags": "false", "max_failures": "5", "tombstone_days": "x", "unknown": 1, "room": None})
    assert (c.mode, c.sync_tags, c.max_failures, c.tombstone_days, c.pushes, c.applies) == ("pull", False, 5, 30, False, False)
    assert SyncConfig.from_options({"mode": "odd"}).mode == "auto"


def test_versions_are_kept_and_pruned(spark, tmp_path):
    for i in range(4):
        last = maintain.write_version(spark, spark.range(i + 1), f"file://{tmp_path}/v", kept=2)
    assert len(list((tmp_path / "v").iterdir())) == 2 and spark.read.parquet(last).count() == 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], OPS)
    assert state.merge(none).count() == 0 and state.snapshot(state.merge(none)).count() == 0
    assert readers.slice_or_empty(spark, "file:///nowhere/at/all", "lists").count() == 0


def test_similar_is_the_best_of_all_pairs(spark):
    """A checksum in most items, equal sets, a repeated and a null checksum, sets of one to nine."""
    draw = random.Random(5)

    def items(first, n):
        found = {first + i: {f"c{draw.randrange(12)}" for _ in range(draw.randrange(1, 10))} | ({"common"} if draw.random() < 0.8 else set()) for i in range(n)}
        return found | {first + n + i: {"common", "c1", "c2"} for i in range(30)}

    remote, local = items(0, 60), items(1000, 60)
    rows = lambda d: [(k, c) for k, v in d.items() for c in (*v, min(v), None)]
    found = match.similar(spark.createDataFrame(rows(remote), "remote_id long, checksum string"), spark.createDataFrame(rows(local), "local_id long, checksum string"))
    want = set()
    for k, a in remote.items():
        score, other = max((len(a & b) / len(a | b), -j) for j, b in local.items())
        if score >= 0.5:
            want.add((k, -other, score))
    assert {tuple(r) for r in found.collect()} == want


def test_ranks_go_on_from_block_to_block(spark):
    rows = [("a", v) for v in range(0, 40000, 7)] + [("b", v) for v in (-5, 4095, 4096, 9000)] + [(None, 3), ("c", None), ("c", 1)]
    out = report.ranked(spark.createDataFrame(rows, "k string, v long").repartition(5), "k", "v", "place").collect()
    want = {("a", v): i + 1 for i, v in enumerate(range(0, 40000, 7))} | {("b", -5): 1, ("b", 4095): 2, ("b", 4096): 3, ("b", 9000): 4, (None, 3): 1, ("c", None): 1, ("c", 1): 2}
    assert {(r.k, r.v): r.place for r in out} == want


def test_only_what_nothing_else_matched_is_compared_by_similarity(spark, monkeypatch):
    sf, asked = "/root/testdata/sf0.001", []
    similar = match.similar
    monkeypatch.setattr(match, "similar", lambda remote, local: asked.append({r.remote_id for r in remote.select("remote_id").collect()}) or similar(remote, local))
    found = {r.remote_id: r.kind for r in catalogue.match_resolved(spark, sf).collect()}
    by_kind = {kind: {r for r, k in found.items() if k == kind} for kind in ("exact", "alias", "fuzzy")}
    assert all(by_kind.values()) and by_kind["fuzzy"] <= asked[0]
    assert not asked[0] & (by_kind["exact"] | by_kind["alias"])
