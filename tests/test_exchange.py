"""Cycles that stop and go on, vaults that are swapped, snapshots that are gated and pulled."""

import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.config import SyncConfig
from palimpsest.operators import cycle, maintain, sections, writes
from palimpsest.plans import exchange
from palimpsest.session import shared_dir
from palimpsest.sources import files, graph, snapshots
from palimpsest.sources.vaults import VaultStore

SF = "/root/testdata/sf0.001"


def folder(spark):
    return f"{shared_dir(spark)}/x-{uuid.uuid4().hex}"


def stage(spark, name, side, built, needs=(), option=None, fails=None):
    def build(done):
        if fails and fails[0]:
            raise RuntimeError("stopped")
        built.append(name)
        seen = "+".join(sorted(r.key for n in needs for r in done[n].collect()))
        return spark.createDataFrame([("i", f"{name}({seen})", "create")], "item string, key string, action string")

    return cycle.Stage(name, side, build, option, tuple(needs))


def test_a_stopped_cycle_goes_on(spark):
    built, fails, at = [], [True], folder(spark)
    stages = [stage(spark, "notes", "apply", built, ["selections"]), stage(spark, "selections", "apply", built), stage(spark, "late", "push", built, ["notes"], fails=fails)]
    cycles = cycle.Cycles(spark, at)
    with pytest.raises(RuntimeError):
        cycles.run(1, stages, SyncConfig())
    assert built == ["selections", "notes"] and cycles.committed(1) is None and cycles.read(1).count() == 0 and cycles.last() is None
    fails[0] = False
    first = sorted(map(tuple, cycles.run(1, stages, SyncConfig()).collect()))
    assert built == ["selections", "notes", "late"], "what was written is not built again"
    assert first == [("late", "i", "late(notes(selections()))", "create"), ("notes", "i", "notes(selections())", "create"), ("selections", "i", "selections()", "create")]
    assert sorted(map(tuple, cycles.run(1, stages, SyncConfig()).collect())) == first and len(built) == 3 and cycles.last() == 1
    whole = cycle.Cycles(spark, folder(spark)).run(1, stages, SyncConfig())
    assert sorted(map(tuple, whole.collect())) == first
    assert {(r.stage, r.action, r.n) for r in cycle.reports(whole).collect()} == {(s, "create", 1) for s in ("late", "notes", "selections")}


def test_what_is_off_is_not_planned(spark):
    built = []
    stages = [stage(spark, "a", "apply", built, option="sync_notes"), stage(spark, "b", "apply", built, ["a"]), stage(spark, "p", "push", built), stage(spark, "q", "push", built, ["b"])]
    names = lambda **o: [s.name for s in cycle.planned(stages, SyncConfig.from_options(o))]
    assert names() == ["a", "b", "p", "q"] and names(mode="push") == ["p"] and names(mode="pull") == [] and names(mode="review") == ["p"] and names(sync_notes="false") == ["p"]
    assert cycle.Cycles(spark, folder(spark)).run(1, stages, SyncConfig(mode="pull")).count() == 0 and built == []
    with pytest.raises(ValueError):
        cycle.planned([stage(spark, "x", "apply", built, ["y"]), stage(spark, "y", "apply", built, ["x"])], SyncConfig())
    with pytest.raises(ValueError):
        cycle.planned([stage(spark, "x", "apply", built, ["gone"])], SyncConfig())


def test_a_pushing_cycle_scans_nothing_to_apply(spark):
    plan = exchange.cycle_push(spark, SF)
    read = {f.split("/cycle-")[1].split("/")[1] for f in plan.inputFiles()}
    assert read == {"push_metadata", "push_tags", "push_notes", "push_selections", "push_transcriptions"}
    assert "apply" not in plan._jdf.queryExecution().executedPlan().toString()


def test_selection_notes_need_what_the_cycle_creates(spark):
    plan = spark.createDataFrame([(1, "s1", "create"), (1, "s2", "no_parent"), (2, "s3", "skip_applied")], "item long, uuid string, action string")
    remote = [(1, "s1", "s1:a", "t", None, "u1"), (1, "s2", "s2:b", "t", None, "u1"), (1, "s3", "s3:c", "t", None, "u1"), (2, "s3", "s3:d", "t", None, "u1"), (2, "s3", "s3:e", "t", None, "u1"), (2, "s3", "s3:f", "", "", "u1"), (2, "s3", "s3:g", "t", None, "u0")]
    remote = spark.createDataFrame(remote, "item long, selection string, key string, text string, html string, author string")
    local = spark.createDataFrame([("s3:d", "a t here"), ("s3:e", "[retracted] t")], "key string, text string")
    out = sections.selection_note_plan(remote, sections.standing_selections(plan), local, "u0")
    assert {r.key: r.action for r in out.collect()} == {"s1:a": "create", "s2:b": "no_parent", "s3:c": "no_parent", "s3:d": "skip_present", "s3:e": "update", "s3:f": "skip_empty", "s3:g": "skip_own"}


def test_a_save_that_stops_leaves_the_old_vaults(spark):
    store = VaultStore(spark, folder(spark))
    vaults = lambda *rows: spark.createDataFrame(rows, "room string, user string, value string")
    asked = spark.createDataFrame([("a b", "u1"), ("a b", "u2"), ("a b", None), ("c", "u1"), ("d", "u1")], "room string, user string")
    load = lambda: {(r.room, r.user): (r.origin, r.vault.pushSeq if r.vault else None) for r in store.load(asked).collect()}
    assert set(load().values()) == {(None, None)}
    seq = lambda n, version=4: f'{{"version":{version},"pushSeq":{n}}}'
    store.save(vaults(("a b", "u1", seq(1)), ("a b", None, seq(2, 1)), ("c", "u1", "{broken"), ("c", "", seq(3)), ("d", "u1", seq(4, 9))))
    before = {("a b", "u1"): ("user", 1), ("a b", "u2"): ("shared", 2), ("a b", None): ("shared", 2), ("c", "u1"): ("user", None), ("d", "u1"): ("user", None)}
    assert load() == before
    beside = store.write(vaults(("a b", "u1", seq(7))))
    assert load() == before, "written beside, not swapped"
    assert store.write(vaults(("a b", "u1", seq(8)))) == beside, "the next save takes its place"
    store.swap(beside)
    assert load() == before | {("a b", "u1"): ("user", 8)}
    for n in range(5):
        store.save(vaults(("d", "u1", seq(n))))
    assert load()["d", "u1"] == ("user", 4) and load()["a b", "u1"] == ("user", 8)
    assert len([n for n in files.names(spark, store.path) if n.startswith("v")]) == 2


def test_snapshots_write_what_changed_and_fits(spark):
    rows = [("r", "i", "tags", "a", "1"), ("r", "i", "tags", "b", "2"), ("r", "j", "notes", "n", "x" * 50), ("q", "k", "notes", "n", "😀" * 200)]
    entries = spark.createDataFrame(rows, "room string, identity string, section string, key string, value string")
    none = spark.createDataFrame([], "room string, identity string, hash string")
    sizes = {r.identity: r["size"] for r in maintain.item_hashes(entries).collect()}
    assert sizes["k"] == len('{"section":"notes","key":"n","value":""}') + 400, "limits count UTF-16 units"
    wrote, told = maintain.gated_snapshot(entries, none, 300)
    assert wrote.filter("room = 'r'").count() == wrote.count() == 3 and {r.identity: r.action for r in told.collect()} == {"i": "write", "j": "write", "k": "skip_size"}
    last = maintain.remembered(told, none)
    again, told = maintain.gated_snapshot(entries, last, 300)
    assert again.count() == 0 and {r.identity: r.action for r in told.collect()} == {"i": "skip_same", "j": "skip_same", "k": "skip_size"}
    changed = entries.withColumn("value", F.when(F.col("key") == "b", "3").otherwise(F.col("value")))
    wrote, told = maintain.gated_snapshot(changed, last, 300)
    assert {r.key for r in wrote.collect()} == {"a", "b"} and maintain.remembered(told, last).count() == 2
    assert maintain.gated_snapshot(entries.limit(0), last, 300)[0].count() == 0


def test_snapshots_are_pulled_by_anyone_and_put_with_a_key(spark):
    snapshots.register(spark)
    at = folder(spark)
    read = lambda: spark.read.format("snapshot").load(at)
    assert read().count() == 0, "nothing there is an empty state"
    d = spark.range(7).selectExpr("concat('i', id) AS identity", "'tags' AS section", "'k' AS key", "'u' AS author", "id AS clock", "'v' AS value", "id = 3 AS deleted", "if(id = 3, 5L, null) AS deleted_at")
    with pytest.raises(Exception, match="pulled only"):
        d.write.format("snapshot").mode("overwrite").save(at)
    assert read().count() == 0
    put = lambda d: d.write.format("snapshot").option("auth", "key").mode("overwrite").save(at)
    put(d.repartition(5))
    assert sorted(map(repr, map(tuple, read().collect()))) == sorted(map(repr, map(tuple, d.collect())))
    put(d.filter("clock < 2"))
    assert read().count() == 2, "the whole state is replaced"
    put(d.limit(0))
    assert read().count() == 0


def test_exported_documents_come_in_parts_of_bounded_size(spark, tmp_path):
    n = 4_500
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 30).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    graphs = exchange._graphs(spark, str(tmp_path))
    per_part = graphs.select(F.size(graph.each(F.col("graph"), "@graph")).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert tuple(per_part) == (100, n)
    items = graph.items_of(graphs).select("document", "ordinal", graph.first_text(F.col("item"), "@id").alias("id")).collect()
    assert len({(i.document, i.ordinal) for i in items}) == n
    for d in range(20):
        mine = [int(i.id[1:]) for i in sorted((i for i in items if i.document == str(d)), key=lambda i: i.ordinal)]
        assert mine == list(range(d, n, 20))


def test_kinds_of_values_are_told_by_the_outermost_level(spark):
    values = ['{"a":[1]}', "{}", "[1]", "[]", "[null]", '"x"', "5", "null", None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, j string").withColumn("v", F.parse_json("j"))
    found = d.orderBy("i").select(graph.is_object(F.col("v")).alias("o"), graph.is_array(F.col("v")).alias("a"), F.size(graph.each(F.col("v"))).alias("n")).collect()
    assert [(r.o, r.a, r.n) for r in found] == [(True, False, 1), (True, False, 1), (False, True, 1), (False, True, 0), (False, True, 1), (False, False, 1), (False, False, 1), (False, False, 0), (False, False, 0)]


def test_a_cycle_gathers_selections_and_fields_once(spark, monkeypatch):
    asked = []
    for owner, name in ((exchange.decisions, "_selection_rows"), (exchange.P, "reconcile_input")):
        f = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, f=f, name=name: asked.append(name) or f(*a))
    exchange.cycle_plan(spark, SF)
    assert sorted(asked) == ["_selection_rows", "reconcile_input"]
    asked.clear()
    exchange.cycle_push(spark, SF)
    assert sorted(asked) == ["_selection_rows", "reconcile_input"]


def test_photos_of_asked_items_are_all_of_theirs(spark):
    asked = spark.range(0, 300, 3).select(F.col("id").alias("item"))
    found = exchange.decisions._item_photos(spark, SF, asked.unionByName(asked))
    photos = exchange.P.photos(spark, SF).filter("local_id < 300 AND local_id % 3 = 0").groupBy(F.col("local_id").alias("item"), "ordinal").agg(F.max("checksum").alias("checksum"))
    assert found.count() > 0 and found.exceptAll(photos).count() == 0 and photos.exceptAll(found).count() == 0


def test_host_actions_leave_rows_without_any_in_the_files(spark):
    at = folder(spark)
    rows = [("apply_notes", "i", "k1", "update"), ("apply_notes", "i", "k2", "dedup"), ("push_notes", "i", "k3", "create"), ("apply_lists", "i", "k4", "update")]
    spark.createDataFrame(rows, "stage string, item string, key string, action string").write.parquet(at)
    d = writes.host_actions(spark.read.parquet(at))
    assert sorted((r.key, r.step, r.type) for r in d.collect()) == [("k1", 1, "note.delete"), ("k1", 2, "note.create")]
    scan = next(line for line in d._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line)
    assert "In(stage" in scan and "push_notes" not in scan
