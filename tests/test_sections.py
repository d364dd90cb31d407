"""Decisions on small hand-made tables: chains of lists, forms of notes, hashes, streams."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import hierarchy, sections, state
from palimpsest.session import shared_dir
from palimpsest.sources import graph
from palimpsest.streaming import oplog, sessions
from palimpsest.streaming.tiers import TieredState


@pytest.mark.parametrize("n", [1, 3, 100])
def test_long_chains_of_lists(spark, n):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, i) for i in range(n)] + [("x", "y", 900), ("y", "x", 901), ("z", "y", 902), ("o", "gone", 903)]
    out = {r.uuid: r.depth for r in hierarchy.depths(spark.createDataFrame(rows, "uuid string, parent string, ordinal int")).collect()}
    assert out == {f"c{i}": i for i in range(n)} | {"x": -1, "y": -1, "z": -1, "o": 0}


def test_names_decide_the_hash_not_their_order(spark):
    d = spark.createDataFrame([("1", "2")], "a string, b string")
    r = d.select(scalar.content_hash("a", "b").alias("x"), scalar.content_hash("b", "a").alias("y"), scalar.content_hash(b=F.col("b"), a=F.col("a")).alias("z"), scalar.content_hash(b=F.col("a"), a=F.col("b")).alias("w")).first()
    assert r.x == r.y == r.z != r.w


def test_notes_are_known_by_every_form(spark):
    rows = [(1, "[a] b", "<p>[a] b</p><p><sub>[overlay:k from u — safe to delete, do not edit]</sub></p>"), (1, None, ""), (2, "x\n[overlay:k from u]", None)]
    forms = [(1, "[a] b"), (1, "b"), (1, "<p>[a] b</p>"), (1, "<p>[a] b</p><p><sub>[overlay:k from u — safe to delete, do not edit]</sub></p>"), (2, "x\n[overlay:k from u]"), (2, "x")]
    d = spark.createDataFrame(rows, "item long, text string, html string")
    assert {(r["item"], bytes(r.form)) for r in sections.known_forms(d).collect()} == {(i, hashlib.sha256(f.encode()).digest()) for i, f in forms}


def test_notes_are_applied_within_their_item(spark):
    """The same note here on another item, a photo of another item, and unsafe html decide nothing."""
    footer = "<p><sub>[overlay:{} from {} — safe to delete, do not edit]</sub></p>"
    remote = [
        (1, "n_a", "same", "<p onclick='x()'>same</p><script>x</script>", None, "u1"), (2, "n_b", "same", "<p>same</p>", None, "u1"), (2, "n_c", "other", None, "p1", "u1"),
        (2, "n_d", "1 < 2", "", "p3", "u<1"), (3, "n_e", "none", None, None, "u1"), (2, "n_f", "mine", None, None, "u0"), (2, "n_g", "", "", None, "u1"), (2, "n_h", "new", None, None, None),
    ]
    local = [(1, None, "same", "<p>same</p>"), (2, "n_h", "old", "<p>old</p>")]
    photos = [(1, 1, "p1"), (2, 2, "p3"), (2, 1, "p2"), (2, 1, "p2")]
    applied = spark.createDataFrame([("n_z", "h", 1)], "key string, hash string, cycle long")
    plan = sections.note_plan(
        spark.createDataFrame(remote, "item long, key string, text string, html string, photo string, author string"), spark.createDataFrame(local, "item long, key string, text string, html string"), applied,
        spark.createDataFrame(photos, "item long, ordinal int, checksum string"), "u0",
    )
    assert {r.key: tuple(r)[2:] for r in plan.collect()} == {
        "n_a": ("dedup", None, None), "n_b": ("create", "p2", "<p>same</p>" + footer.format("n_b", "u1")), "n_c": ("no_parent", None, None), "n_d": ("create", "p3", "<p>1 &lt; 2</p>" + footer.format("n_d", "u&lt;1")),
        "n_e": ("no_parent", None, None), "n_f": ("skip_own", None, None), "n_g": ("skip_empty", None, None), "n_h": ("update", "p2", "<p>new</p>" + footer.format("n_h", "unknown")),
    }
    after = {r.key: (r.hash, r.cycle) for r in sections.applied_notes(plan, applied, 2).collect()}
    assert set(after) == {"n_a", "n_b", "n_d", "n_h", "n_z"} and after["n_z"] == ("h", 1) and after["n_a"] == (None, 2) and after["n_b"][1] == 2


def test_aliases_die_of_age(spark):
    links = spark.createDataFrame([("n1", "o1", "n1", 1, 5), ("n1", "o1", "n2", 5, 30), ("n3", "o3", "n3", 2, 10), ("n4", "o4", "n4", 3, None), ("n5", "o5", "n5", 4, 0), ("n6", "o6", "n6", 4, 20)], "identity string, old_identity string, target string, clock long, created long")
    a = sections.aliases(links)
    assert ("n1", "o1", "n2", 30) in [tuple(r) for r in a.collect()] and a.count() == 5
    left = lambda gone: sorted({r.identity for r in a.collect()} - {r.identity for r in gone.collect()})
    assert left(sections.purged_aliases(a, None)) == []
    assert left(sections.purged_aliases(a, 20)) == left(sections.purged_aliases(a, 20, server=True)) == ["n1", "n6"]
    with pytest.raises(ValueError):
        sections.purged_aliases(a, None, server=True)


def test_hashes_take_linear_time(spark):
    """Texts of 200,000 characters, whose hash was once a pass over the text for each of them."""
    d = spark.range(4).select(F.repeat(F.lit("note é😀 "), 25_000).alias("t"))
    assert {len(r[0]) for r in d.select(scalar.note_key(F.col("t"), F.lit(None).cast("string"))).collect()} == {24}


def test_changes_of_slices(spark):
    side = lambda rows: spark.createDataFrame(rows, "k string, hash string")
    assert sorted(map(tuple, sections.local_changes(side([("a", "1"), ("b", "2"), ("c", "3")]), side([("a", "1"), ("b", "9"), ("d", "4")]), ["k"]).collect())) == [("b", "changed"), ("c", "added"), ("d", "removed")]


KINDS = "identity string, section string, key string, author string, clock long, value string, deleted boolean, at long"


def test_tiers_agree_with_the_batch(spark):
    ops = spark.range(200).select(
        F.concat(F.lit("i"), F.col("id") % 7).alias("identity"), F.lit("tags").alias("section"), F.concat(F.lit("k"), F.col("id") % 5).alias("key"), F.concat(F.lit("u"), F.col("id") % 3).alias("author"),
        (F.col("id") * 7 % 200).alias("clock"), F.col("id").cast("string").alias("value"), (F.col("id") % 9 == 0).alias("deleted"), F.col("id").alias("at"),
    )
    merged = state.merge(ops)
    told = lambda d: sorted(map(repr, map(tuple, d.select(*merged.columns).collect())))
    assert told(oplog.replay(spark, ops)) == told(merged)
    tiers = TieredState(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", fan=2)
    assert tiers.read().count() == 0
    for n in range(7):
        part = ops.filter(F.col("clock") % 7 == n)
        tiers.absorb(part, n)
        tiers.absorb(part, n)  # a batch that runs twice
    assert told(tiers.read()) == told(merged)
    assert [r["level"] for r in tiers.manifest()["runs"]] == [2, 1, 0]
    tiers.compact()
    tiers.absorb(ops, 7)  # all of it again
    assert told(tiers.read()) == told(merged)
    assert oplog.replay(spark, ops.limit(0)).count() == 0


def test_a_batch_writes_what_it_changes(spark):
    """One key in a hundred changes: the batch's run has a hundredth of the rows; ten batches rewrite a tenth, not ten times all."""
    tiers = TieredState(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    op = lambda n, m, clock: spark.range(n).selectExpr("concat('i', id) AS identity", "'tags' AS section", "'k' AS key", "'u' AS author", f"{clock}L AS clock", "'v' AS value", "false AS deleted", f"{clock}L AS at").limit(m)
    rows = lambda m: sum(spark.read.parquet(f"{tiers.path}/runs/{r['name']}").count() for r in m["runs"])
    tiers.absorb(op(10_000, 10_000, 0), 0)
    for n in range(1, 7):
        before = {r["name"] for r in tiers.manifest()["runs"]}
        tiers.absorb(op(100, 100, n), n)
        new = [r for r in tiers.manifest()["runs"] if r["name"] not in before]
        assert [spark.read.parquet(f"{tiers.path}/runs/{r['name']}").count() for r in new] == [100]
    assert rows(tiers.manifest()) == 10_600 and tiers.read().count() == 10_000


def test_tombstones_expire_and_keys_come_back(spark):
    """A tombstone hides older values until it is too old; a late op then brings its key back, as on a peer that purged it."""
    tiers = TieredState(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", ttl_ms=10, fan=3)
    send = lambda n, *rows: tiers.absorb(spark.createDataFrame([("i", "tags", k, "u", c, v, gone, at) for k, c, v, gone, at in rows], KINDS), n)
    now = lambda: {r.key: (r.value, r.deleted) for r in tiers.read().collect()}
    send(0, ("a", 1, "old", False, 1), ("b", 1, "kept", False, 1))
    send(1, ("a", 5, None, True, 5))
    assert now()["a"] == (None, True)
    tiers.compact()
    assert now()["a"] == (None, True), "not old yet"
    send(2, ("c", 6, "x", False, 30))
    tiers.compact()
    assert now() == {"b": ("kept", False), "c": ("x", False)}
    send(3, ("a", 2, "late", False, 31))
    assert now()["a"] == ("late", False)
    # a tombstone in a younger run must not go before it met the oldest one
    send(4, ("b", 9, None, True, 2), ("z", 9, "z", False, 99))
    for n in range(5, 9):
        send(n, ("z", 10 + n, "z", False, 99))
        assert now().get("b", (None, True)) == (None, True), "the value that it hides is not back"


def test_bursts_end_by_quiet_and_clients_by_silence(spark):
    rows = [("i", "u1", 0), ("i", "u1", 900), ("i", "u1", 2500), ("j", "u1", 1000), (None, "u1", 5), ("i", "u0", 1700)]
    d = spark.createDataFrame(rows, "identity string, author string, at long")
    out = sessions.replay(spark, d, lambda s: sessions.bursts(oplog.foreign_ops(s, "u0"), "1 second", late="1 minute"))
    assert sorted(map(tuple, out.collect()), key=repr) == [("i", 0, 900, 2), ("i", 2500, 2500, 1), ("j", 1000, 1000, 1), (None, 5, 5, 1)]
    beats = spark.createDataFrame([("r", "a", "A", 0), ("r", "a", None, 800), ("r", "b", None, 100), ("r", "a", "AA", 5000), ("q", "a", "Q", 1)], "room string, client string, name string, at long")
    out = sessions.replay(spark, beats, lambda s: sessions.presence(s, "1 second", late="1 minute"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("r", "a", "A", 0, 800, 1800), ("r", "b", None, 100, 100, 1100), ("r", "a", "AA", 5000, 5000, 6000), ("q", "a", "Q", 1, 1, 1001)], key=repr)


def test_feeds(spark):
    d = spark.createDataFrame([("i1", "s", "u0"), ("i1", "s", "u1"), ("i2", "t", None)], "identity string, section string, author string")
    assert sorted(map(tuple, oplog.change_feed(d, "u0").collect())) == [("i1", "s"), ("i2", "t")]


def test_graphs_in_every_form(spark, tmp_path):
    v = "http://example.org/vocab/"
    context = {"dc": "http://purl.org/dc/elements/1.1/", "bad": "noslash", "when": {"@id": "http://e.org/when", "@type": "date"}, "none": {"@type": "x"}, "@vocab": v}
    items = [
        {"@id": "a", "plain": "p", "dc:title:lost": "t", "bad:x": "b", "when": "w", "none": 3, "http://full/y": {"text": "f", "type": "k", "language": "fr"}, "list": [2], "_rev": "r", "photo": {"checksum": "c1"}},
        {f"{v}photo": [{f"{v}checksum": {"@value": "c2"}, f"{v}selection": {"checksum": "q"}}, {"checksum": ""}, {"note": None}], "when": {"@value": "typed", "@type": "own"}, "when2": ["x"], "nothing": None},
        {"photo": [], "plain": "no identity"},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"@context": context, "@graph": items}))
    (tmp_path / "b.json").write_text(json.dumps([{"photo": {"checksum": 7}, "plain": "bare"}]))
    (tmp_path / "c.json").write_text("{broken")
    g = graph.graphs(spark, str(tmp_path)).cache()
    found = graph.items_of(g)
    sums = {(r.document[-6:], r.ordinal): r.c for r in found.select("document", "ordinal", graph.checksums(F.col("item"), v).alias("c")).collect()}
    assert sums == {("a.json", 0): ["c1"], ("a.json", 1): ["c2", "q"], ("a.json", 2): [], ("b.json", 0): ["7"]}
    full = graph.expand(found, graph.terms_of(g)).select("document", "ordinal", "key", graph.literal(F.col("value"), F.col("type")).alias("v"))
    told = {(r.document[-6:], r.ordinal, r.key): tuple(r.v) for r in full.collect()}
    string = graph.STRING
    assert told["a.json", 0, v + "plain"] == ("p", string, None) and told["a.json", 0, "http://purl.org/dc/elements/1.1/title"] == ("t", string, None)
    assert told["a.json", 0, "bad:x"] == ("b", string, None) and told["a.json", 0, "http://e.org/when"] == ("w", "date", None) and told["a.json", 0, v + "none"] == ("3", string, None)
    assert told["a.json", 0, "http://full/y"] == ("f", "k", "fr") and told["a.json", 1, "http://e.org/when"] == ("typed", "own", None) and told["a.json", 1, v + "when2"] == ("", string, None)
    assert ("a.json", 0, "list") in told and ("b.json", 0, "plain") in told
    ops = graph.export_ops(found, graph.terms_of(g), "me", 4, v).collect()
    assert {(o.section, o.key) for o in ops} >= {("metadata", v + "plain"), ("metadata", "http://full/y")} and len({o.identity for o in ops}) == 2
    assert graph.export_ops(found.limit(0), graph.terms_of(g), "me", 4, v).count() == 0
    assert spark.range(1).select(graph.split_list(F.lit(",a,,b"))).first()[0] == ["a", "b"]
