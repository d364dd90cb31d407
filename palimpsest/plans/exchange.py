"""Queries of what goes between replicas and over time: exported graphs, stored vaults, snapshots, running streams and
whole cycles, each with its twin in DuckDB's SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from palimpsest.config import SyncConfig
from palimpsest.functions.scalar import FNV_SEEDS, fast_hash, identity_of
from palimpsest.operators import cycle, items, maintain, sections, state, writes
from palimpsest.plans import catalogue
from palimpsest.plans import sections as decisions
from palimpsest.plans.catalogue import _CUT, _OPS, _PHOTOS, _STATE, ME
from palimpsest.plans.registry import SQL, query
from palimpsest.session import shared_dir, written
from palimpsest.sources import graph, readers, snapshots
from palimpsest.sources import projections as P
from palimpsest.sources.vaults import VaultStore
from palimpsest.streaming import oplog, sessions

# --- graphs --------------------------------------------------------------------------------------

VOCAB = "http://example.org/vocab/"
_CONTEXT = (
    '{"dc":"http://purl.org/dc/elements/1.1/","when":{"@id":"http://example.org/when","@type":"http://www.w3.org/2001/XMLSchema#date"},'
    '"many":{"@id":"http://example.org/many","@container":"@set"},"@vocab":"http://example.org/vocab/"}'
)
_SHOTS = """shots AS (SELECT local_id, ordinal, max(checksum) AS checksum FROM photos GROUP BY 1, 2),
  kept AS (SELECT s.*, CAST(substr(checksum, 3) AS BIGINT) AS part, min(ordinal) OVER (PARTITION BY local_id) AS first FROM shots s)"""
#: Photos that an item's JSON has: all of them, or the first alone where the photo is no array.
_KEPT = f"{_PHOTOS}, {_SHOTS}, shot AS (SELECT * FROM kept WHERE local_id % 3 <> 2 OR ordinal = first)"


#: Orders that give each of the twenty documents one part, of a hundred items: a whole document is too large for one value.
_PART = 2_000


def _graphs(spark, sf_dir):
    """Exports of orders, twenty documents in parts: items in compact form, in expanded form, and with one photo that is no array.

    Orders and lines are dealt out once, by the range of their number, while they are narrow; no JSON is shuffled."""
    place = F.floor(F.col("local_id") / _PART).alias("place")
    lines = P.photos(spark, sf_dir).select(place, "local_id", "ordinal", "checksum", F.lit(False).alias("ordered"))
    orders = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit(True).alias("ordered"))
    rows = lines.unionByName(orders.select(place, "*"), allowMissingColumns=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place")
    p = rows.groupBy("place", "local_id", "ordered", "ordinal").agg(*[F.max(c).alias(c) for c in ("checksum", "status", "priority")])
    part, number = F.substring("checksum", 3, 20).cast("long"), F.concat_ws("_", "local_id", "ordinal")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    note = (
        F.when(part % 5 == 0, text('"note":{"@id":"n', number, '","text":"a note","html":"<u>a note</u>"},'))
        .when(part % 5 == 1, text('"note":[{"html":{"@value":"<p>x</p>"}},null],'))
        .when(part % 5 == 2, '"note":{"text":"echo","html":"<p>echo</p><p><sub>[overlay:n_1 from u1 — safe]</sub></p>"},')
        .otherwise("")
    )
    selection = F.when(part % 3 == 0, text('"selection":{"id":"s', number, '","checksum":"q', part, '","x":1,"y":2.5,"width":', part % 2, ',"height":4,"note":{"text":"inside"},"transcription":{"text":"read"}},')).otherwise("")
    tx = F.when(part % 7 == 0, text('"transcription":[{"@id":"t', number, '","text":"whole","data":{"lines":[1,2]}}],')).otherwise("")
    body = text(note, selection, tx, '"metadata":{"id":7,"dc:size":{"text":"', part % 9, '","type":"int"},"empty":""}}')
    plain, full = text('{"checksum":"', F.col("checksum"), '",', body), text(f'{{"{VOCAB}checksum":{{"@value":"', F.col("checksum"), '"},', body)
    shot = F.when(~F.col("ordered"), F.struct("ordinal", F.when(F.col("local_id") % 3 == 1, full).otherwise(plain).alias("json")))
    o = p.groupBy("place", "local_id").agg(F.max("status").alias("status"), F.max("priority").alias("priority"), F.max("ordered").alias("ordered"), F.sort_array(F.collect_list(shot)).alias("p")).filter("ordered")
    o = o.withColumn("p", F.when(F.size("p") > 0, F.col("p")))
    every = F.array_join(F.col("p")["json"], ",")
    form = F.col("local_id") % 3
    photo = F.when(form == 0, text('"photo":[', every, "]")).when(form == 1, text(f'"{VOCAB}photo":[', every, "]")).otherwise(text('"photo":', F.col("p")[0]["json"]))
    tag = F.element_at(F.array(F.lit('"tag":"Red",'), F.lit('"tag":{"name":"Blue","color":"c1"},'), F.lit('"tag":["A","b",{"@value":"c"}],'), F.lit("")), (F.col("local_id") % 4 + 1).cast("int"))
    item = text('{"@id":"i', F.col("local_id"), '","@type":"Item","title":"', F.col("priority"), '","when":"', F.col("status"), '","many":["x"],"dc:date":{"@value":"d', F.col("local_id") % 7, '","@type":"date","@language":"en"},"list":[1],', tag)
    item = text(item, F.coalesce(photo, F.lit('"photo":[]')), "}")
    document = F.col("local_id") % 20
    d = o.groupBy("place", document.alias("document")).agg(F.sort_array(F.collect_list(F.struct("local_id", item.alias("json")))).alias("i"))
    whole = F.concat(F.lit(f'{{"@context":{_CONTEXT},"version":"1","@graph":['), F.array_join(F.col("i")["json"], ","), F.lit("]}"))
    return written(d.select(F.col("document").cast("string").alias("document"), (F.col("place") * _PART).alias("first"), F.parse_json(whole).alias("graph")), "graphs", group_bytes=16 << 20)


@query(f"""WITH {_KEPT}, c AS (SELECT local_id, ordinal, unnest(CASE WHEN part % 3 = 0 THEN [checksum, 'q' || part] ELSE [checksum] END) AS c FROM shot)
  SELECT 'i' || local_id AS id, substr(sha256(string_agg(c, ':' ORDER BY c)), 1, 32) AS identity, string_agg(c, ',' ORDER BY c) AS checksums, count(*) AS n FROM c GROUP BY local_id""")
def graph_checksums(spark, sf_dir):
    d = graph.items_of(_graphs(spark, sf_dir)).select(graph.first_text(F.col("item"), "@id").alias("id"), graph.checksums(F.col("item"), VOCAB).alias("c"))
    stored = graph.computed(d, "stored", F.array_sort(graph.split_list(graph.join_list(F.col("c"))))).select("id", F.col("stored").alias("c")).filter("size(c) > 0")
    return stored.select("id", identity_of(F.col("c")).alias("identity"), graph.join_list(F.col("c")).alias("checksums"), F.size("c").cast("long").alias("n"))


_ITEMS = f"{_KEPT}, o AS (SELECT o_orderkey AS local_id, max(o_orderstatus) AS status, max(o_orderpriority) AS priority FROM orders GROUP BY 1)"


@query(f"""WITH {_ITEMS}, v AS (SELECT local_id, unnest([
    {{'key': '{VOCAB}title', 'text': priority, 'type': '{graph.STRING}', 'language': NULL, 'container': NULL}},
    {{'key': 'http://example.org/when', 'text': status, 'type': 'http://www.w3.org/2001/XMLSchema#date', 'language': NULL, 'container': NULL}},
    {{'key': 'http://example.org/many', 'text': '', 'type': '{graph.STRING}', 'language': NULL, 'container': '@set'}},
    {{'key': 'http://purl.org/dc/elements/1.1/date', 'text': 'd' || local_id % 7, 'type': 'date', 'language': 'en', 'container': NULL}}]) AS m FROM o)
  SELECT 'i' || local_id AS id, m.key AS key, m.text AS text, m.type AS type, m.language AS language, m.container AS container FROM v""")
def graph_expand(spark, sf_dir):
    """Metadata of exported items by the terms of their documents' contexts, typed by them."""
    graphs = _graphs(spark, sf_dir)
    found = graph.items_of(graphs).withColumn("id", graph.first_text(F.col("item"), "@id"))
    d = graph.expand(found, written(graph.terms_of(graphs), "graph-terms")).filter(~F.col("key").rlike("^@") & ~F.col("key").isin("list", "tag", "photo", f"{VOCAB}photo"))
    return d.select("id", "key", graph.literal(F.col("value"), F.col("type")).alias("v"), "container").select("id", "key", "v.*", "container")


_NEW = "{0} || substr(sha256({1}), 1, 32)"
_UNIT = "chr(31)"
_SEL_ID = _NEW.format("'s_'", f"'id' || {_UNIT} || 's' || n")
_SHAPE = "CAST(part % 2 AS DOUBLE)"


@query(f"""WITH {_ITEMS}, c AS (SELECT local_id, unnest(CASE WHEN part % 3 = 0 THEN [checksum, 'q' || part] ELSE [checksum] END) AS c FROM shot),
  ids AS (SELECT local_id, local_id % 20 AS document, substr(sha256(string_agg(c, ':' ORDER BY c)), 1, 32) AS identity FROM c GROUP BY local_id),
  s AS (SELECT shot.*, identity, local_id || '_' || ordinal AS n, row_number() OVER (PARTITION BY local_id ORDER BY ordinal) - 1 AS place FROM shot JOIN ids USING (local_id)),
  m AS (SELECT local_id, unnest([
      {{'section': 'metadata', 'key': '{VOCAB}title', 'value': '{{"text":"' || priority || '","type":"{graph.STRING}"}}'}},
      {{'section': 'metadata', 'key': 'http://example.org/when', 'value': '{{"text":"' || status || '","type":"http://www.w3.org/2001/XMLSchema#date"}}'}},
      {{'section': 'metadata', 'key': 'http://purl.org/dc/elements/1.1/date', 'value': '{{"text":"d' || local_id % 7 || '","type":"date","language":"en"}}'}}]
      || CASE local_id % 4 WHEN 0 THEN [{{'section': 'tags', 'key': 'red', 'value': '{{"name":"Red"}}'}}] WHEN 1 THEN [{{'section': 'tags', 'key': 'blue', 'value': '{{"name":"Blue","color":"c1"}}'}}]
        WHEN 2 THEN [{{'section': 'tags', 'key': 'a', 'value': '{{"name":"A"}}'}}, {{'section': 'tags', 'key': 'b', 'value': '{{"name":"b"}}'}}, {{'section': 'tags', 'key': 'c', 'value': '{{"name":"c"}}'}}] ELSE [] END) AS e FROM o),
  p AS (SELECT local_id, unnest([{{'section': 'photos', 'key': checksum || ':dc:size', 'value': '{{"text":"' || part % 9 || '","type":"int"}}'}}]
      || CASE part % 5 WHEN 0 THEN [{{'section': 'notes', 'key': {_NEW.format("'n_'", f"'id' || {_UNIT} || 'n' || n")}, 'value': '{{"text":"a note","html":"<span style=\\"text-decoration: underline\\">a note</span>","photo":"' || checksum || '"}}'}}]
        WHEN 1 THEN [{{'section': 'notes', 'key': {_NEW.format("'n_'", f"identity || {_UNIT} || place || {_UNIT} || 0")}, 'value': '{{"text":"","html":"<p>x</p>","photo":"' || checksum || '"}}'}}] ELSE [] END
      || CASE WHEN part % 7 = 0 THEN [{{'section': 'transcriptions', 'key': {_NEW.format("'t_'", f"'id' || {_UNIT} || 't' || n")}, 'value': '{{"text":"whole","data":"{{\\"lines\\":[1,2]}}","photo":"' || checksum || '"}}'}}] ELSE [] END
      || CASE WHEN part % 3 = 0 THEN [{{'section': 'selectionNotes', 'key': {_SEL_ID} || ':' || {_NEW.format("'n_'", f"identity || {_UNIT} || {_SEL_ID} || {_UNIT} || 0")}, 'value': '{{"text":"inside","html":""}}'}},
          {{'section': 'transcriptions', 'key': {_NEW.format("'t_'", f"identity || {_UNIT} || {_SEL_ID} || {_UNIT} || 0")}, 'value': '{{"text":"read","photo":"' || checksum || '","selection":"' || {_SEL_ID} || '"}}'}}] ELSE [] END
      || CASE WHEN part % 6 = 3 THEN [{{'section': 'selections', 'key': {_SEL_ID}, 'value': '{{"x":1.0,"y":2.5,"w":1.0,"h":4.0,"angle":0.0,"photo":"' || checksum || '"}}'}}] ELSE [] END) AS e FROM s),
  every AS (SELECT local_id, e FROM m UNION ALL SELECT local_id, e FROM p)
  SELECT identity, e.section AS section, e.key AS key, 'u0' AS author, CAST(9 AS BIGINT) AS clock, e.value AS value FROM every JOIN ids USING (local_id)
  QUALIFY row_number() OVER (PARTITION BY identity, e.section, e.key ORDER BY CAST(document AS VARCHAR) DESC, local_id DESC, e.value DESC) = 1""")
def export_ops(spark, sf_dir):
    graphs = _graphs(spark, sf_dir)
    return graph.export_ops(graph.items_of(graphs), graph.terms_of(graphs), ME, 9, VOCAB, spread=True).drop("deleted", "at")


# --- running streams -----------------------------------------------------------------------------


@query(f"""WITH {_STATE}{_CUT} SELECT * FROM state WHERE NOT (deleted AND deleted_at < (SELECT max("at") FROM ops) - {10 * 86_400_000})""")
def stream_expiry(spark, sf_dir):
    """The op-log streamed in six parts by time into tiers that merge two by two; tombstones of more than ten days expire."""
    return oplog.replay_tiers(spark, P.ops(spark, sf_dir), parts=6, ttl_ms=10 * 86_400_000, fan=2).read()


QUIET_MS = 6 * 3_600_000
_ISLANDS = """i AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY "at") AS burst FROM (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY {k} ORDER BY "at") < {quiet} THEN 0 ELSE 1 END AS new FROM {t}))"""


@query(f"""WITH {_OPS}, f AS (SELECT * FROM ops WHERE author <> 'u0'), {_ISLANDS.format(k="identity", quiet=QUIET_MS, t="f")} SELECT identity, min("at") AS first, max("at") AS last, count(*) AS n FROM i GROUP BY identity, burst""")
def debounced_changes(spark, sf_dir):
    """Bursts of what others changed, one row each once an item was quiet for six hours, as a running query."""
    ops = P.ops(spark, sf_dir).select("identity", "author", "at")
    return sessions.replay(spark, ops, lambda s: sessions.bursts(oplog.foreign_ops(s, ME), f"{QUIET_MS} milliseconds", late="11 days"))


@query(f"""WITH b AS (SELECT 'room' || (user_id % 4) AS room, 'u' || user_id AS client, CASE WHEN event_id % 3 = 0 THEN 'name' || (event_id % 9) END AS name, epoch_us(ts) // 1000 AS "at" FROM events),
  {_ISLANDS.format(k="room, client", quiet=QUIET_MS, t="b")} SELECT room, client, arg_max(name, "at") FILTER (name IS NOT NULL) AS name, min("at") AS since, max("at") AS last, max("at") + {QUIET_MS} AS expired FROM i GROUP BY room, client, burst""")
def live_presence(spark, sf_dir):
    """Stays of clients in rooms: one row once a client was silent for six hours."""
    e = P.read(spark, sf_dir, "events")
    beats = e.select(F.concat(F.lit("room"), F.col("user_id") % 4).alias("room"), F.concat(F.lit("u"), "user_id").alias("client"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("name"), F.col("event_id") % 9)).alias("name"), P.millis("ts").alias("at"))
    return sessions.replay(spark, beats, lambda s: sessions.presence(s, f"{QUIET_MS} milliseconds", late="11 days"))


# --- stores --------------------------------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {_OPS}, u AS (SELECT CAST(substr(author, 2) AS BIGINT) AS n, author, 'room ' || (clock % 40) AS room, max(clock) AS seq FROM ops GROUP BY ALL),
  r AS (SELECT room, CAST(substr(room, 6) AS BIGINT) AS k, max(seq) AS seq FROM u GROUP BY 1, 2)
  SELECT u.room, author AS user, CASE WHEN n % 2 = 0 THEN 'user' WHEN k % 3 <> 0 THEN 'shared' END AS origin,
    CASE WHEN n = 4 THEN NULL WHEN n % 2 = 0 THEN u.seq + CASE WHEN k % 4 = 0 THEN 1000 ELSE 0 END WHEN k % 3 <> 0 THEN r.seq END AS push_seq FROM u JOIN r USING (room)""")
def vault_store(spark, sf_dir):
    """Vaults of users, of rooms that have a shared one, and of neither, after two saves; one user's text is broken."""
    ops = P.ops(spark, sf_dir)
    users = ops.groupBy("author", F.concat(F.lit("room "), F.col("clock") % 40).alias("room")).agg(F.max("clock").alias("seq")).withColumn("n", F.substring("author", 2, 5).cast("long")).withColumn("k", F.substring("room", 6, 5).cast("long"))
    text = lambda seq: F.concat(F.lit('{"version":4,"pushSeq":'), seq.cast("string"), F.lit("}"))
    own = users.filter("n % 2 = 0").select("room", F.col("author").alias("user"), F.when(F.col("n") == 4, "{broken").otherwise(text(F.col("seq"))).alias("value"))
    shared = users.filter("k % 3 <> 0").groupBy("room").agg(F.max("seq").alias("seq")).select("room", F.lit(None).cast("string").alias("user"), text(F.col("seq")).alias("value"))
    later = users.filter("n % 2 = 0 AND n <> 4 AND k % 4 = 0").select("room", F.col("author").alias("user"), text(F.col("seq") + 1000).alias("value"))
    store = VaultStore(spark, _folder(spark, "vaults"))
    store.save(own.unionByName(shared))
    store.save(later)
    return store.load(users.select("room", F.col("author").alias("user"))).select("room", "user", "origin", F.col("vault.pushSeq").alias("push_seq"))


_ENTRIES = """, live AS (SELECT 'room' || (CAST(substr(identity, 5) AS BIGINT) % 20) AS room, identity, section, key, value, CAST(substr(identity, 5) AS BIGINT) AS n,
    '{"section":"' || section || '","key":"' || key || '","value":"' || value || '"}' AS text FROM state WHERE NOT deleted),
  now AS (SELECT room, identity, n, sum(length(text)) AS size FROM live GROUP BY ALL), changed AS (SELECT * FROM now WHERE n % 3 <> 0),
  fits AS (SELECT room FROM changed GROUP BY room HAVING sum(size) <= 12000)"""


@query(f"WITH {_STATE}{_ENTRIES} SELECT room, identity, section, key, value FROM live WHERE n % 3 <> 0 AND room IN (FROM fits)")
def capped_snapshot(spark, sf_dir):
    """What a snapshot writes where a third of the items did not change since the last, in rooms that are not too large."""
    live = state.live(state.merge(P.ops(spark, sf_dir))).withColumn("n", F.substring("identity", 5, 20).cast("long"))
    entries = live.select(F.concat(F.lit("room"), F.col("n") % 20).alias("room"), "identity", "section", "key", "value", "n")
    last = maintain.item_hashes(entries).withColumn("n", F.substring("identity", 5, 20).cast("long"))
    last = last.select("room", "identity", F.when(F.col("n") % 3 == 0, F.col("hash")).when(F.col("n") % 3 == 1, "older").alias("hash")).filter("hash IS NOT NULL")
    return maintain.gated_snapshot(entries.drop("n"), last, 12_000)[0].select("room", "identity", "section", "key", "value")


@query(f"WITH {_STATE} SELECT * FROM state")
def snapshot_source(spark, sf_dir):
    """A replica's state put where others pull it, pulled and merged with our ops; a snapshot that nobody put is empty."""
    snapshots.register(spark)
    ops, at = P.ops(spark, sf_dir), _folder(spark, "snapshot")
    theirs = state.merge(ops.filter("clock % 2 = 0")).select(*[c.split()[0] for c in snapshots.ENTRY.split(", ")])
    theirs.write.format("snapshot").option("auth", "key").mode("overwrite").save(at)
    pulled = spark.read.format("snapshot").load(at).unionByName(spark.read.format("snapshot").load(f"{at}-none"))
    return state.merge(sections.snapshot_ops(pulled, ops.filter("clock % 2 = 1")))


# --- cycles --------------------------------------------------------------------------------------


def _rows(d, item, key):
    return d.select(F.col(item).cast("string").alias("item") if item else F.lit(None).cast("string").alias("item"), F.concat_ws(":", *key).alias("key"), "action")


def _selection_notes(spark, sf_dir, selections, every):
    remote = decisions._selections(spark, sf_dir, every)[1].filter("part % 5 <> 4 AND NOT deleted")
    note = F.concat(F.lit("note "), F.col("part"))
    remote = remote.select("item", F.col("uuid").alias("selection"), F.concat("uuid", F.lit(":n")).alias("key"), note.alias("text"), F.lit(None).cast("string").alias("html"), F.concat(F.lit("u"), F.col("part") % 3).alias("author"), "part")
    local = remote.filter("part % 7 < 2").select("key", F.when(F.col("part") % 7 == 0, F.col("text")).otherwise("[retracted]").alias("text"))
    return sections.selection_note_plan(remote, selections, local, ME)


def _selection_metadata(spark, sf_dir, selections, every):
    local, remote, pushed = decisions._selection_fields(spark, sf_dir, every)
    return sections.apply_fields(remote, selections.select("uuid"), local.filter("part % 7 <> 0"), pushed, ["uuid", "prop"], ME)


def stages(spark, sf_dir):
    """The stages of a cycle in their order: notes and metadata of selections need the selections that are here by then.

    Selections and fields, which several stages read, are gathered and written once, by the first planned stage that
    asks for them."""
    q = lambda f: lambda _: f(spark, sf_dir)
    selections = functools.cache(lambda: written(decisions._selection_rows(spark, sf_dir), "cycle-selections"))
    metadata = functools.cache(lambda: written(P.reconcile_input(spark, sf_dir), "cycle-fields"))
    of = lambda f, every: lambda _: f(spark, sf_dir, every())
    rows = lambda f, item, *key: lambda done: _rows(f(done), item, key)
    here = lambda done: sections.standing_selections(done["apply_selections"].select("item", F.col("key").alias("uuid"), "action"))
    A, P_, S = cycle.APPLY, cycle.PUSH, cycle.Stage
    return [
        S("apply_metadata", A, rows(of(catalogue.apply_plan_metadata, metadata), "identity", "key"), "sync_metadata"),
        S("apply_tags", A, rows(q(catalogue.apply_tags), "identity", "key"), "sync_tags"),
        S("apply_notes", A, rows(q(decisions.apply_plan_notes), "item", "key"), "sync_notes"),
        S("apply_photos", A, rows(q(decisions.apply_plan_photos), None, "photo", "prop"), "sync_photo_adjustments"),
        S("apply_selection_notes", A, rows(lambda done: _selection_notes(spark, sf_dir, here(done), selections()), "item", "key"), "sync_notes", ("apply_selections",)),
        S("apply_selections", A, rows(of(decisions.apply_plan_selections, selections), "item", "uuid"), "sync_selections"),
        S("apply_selection_metadata", A, rows(lambda done: _selection_metadata(spark, sf_dir, here(done), selections()), None, "uuid", "prop"), "sync_photo_adjustments", ("apply_selections",)),
        S("apply_transcriptions", A, rows(q(decisions.apply_plan_transcriptions), "item", "uuid"), "sync_transcriptions"),
        S("apply_lists", A, rows(q(decisions.apply_plan_lists), "identity", "name"), "sync_lists"),
        S("push_metadata", P_, rows(of(catalogue.push_plan_metadata, metadata), "identity", "key"), "sync_metadata"),
        S("push_tags", P_, rows(q(catalogue.push_plan_tags), "identity", "key"), "sync_tags"),
        S("push_notes", P_, rows(q(decisions.push_plan_notes), None, "key"), "sync_notes"),
        S("push_photos", P_, rows(q(decisions.push_plan_photos), None, "photo", "prop"), "sync_photo_adjustments"),
        S("push_selections", P_, rows(of(decisions.push_plan_selections, selections), None, "uuid"), "sync_selections"),
        S("push_selection_metadata", P_, rows(of(decisions.push_plan_selection_metadata, selections), None, "uuid", "prop"), "sync_photo_adjustments"),
        S("push_transcriptions", P_, rows(q(decisions.push_plan_transcriptions), None, "uuid"), "sync_transcriptions"),
    ]


_PUSHED = {"push_metadata": ("push_plan_metadata", "identity", "key"), "push_tags": ("push_plan_tags", "identity", "key"), "push_notes": ("push_plan_notes", "NULL", "key"), "push_photos": ("push_plan_photos", "NULL", "photo || ':' || prop"),
    "push_selections": ("push_plan_selections", "NULL", "uuid"), "push_selection_metadata": ("push_plan_selection_metadata", "NULL", "uuid || ':' || prop"), "push_transcriptions": ("push_plan_transcriptions", "NULL", "uuid")}
_APPLIED = {"apply_metadata": ("apply_plan_metadata", "identity", "key"), "apply_tags": ("apply_tags", "identity", "key"), "apply_notes": ("apply_plan_notes", "CAST(item AS VARCHAR)", "key"), "apply_photos": ("apply_plan_photos", "NULL", "photo || ':' || prop"),
    "apply_selections": ("apply_plan_selections", "CAST(item AS VARCHAR)", "uuid"), "apply_transcriptions": ("apply_plan_transcriptions", "CAST(item AS VARCHAR)", "uuid"), "apply_lists": ("apply_plan_lists", "identity", "name")}


def _told(named):
    return " UNION ALL ".join(f"SELECT '{stage}' AS stage, CAST({item} AS VARCHAR) AS item, {key} AS key, action FROM ({SQL[name]})" for stage, (name, item, key) in named.items())


_STANDING = f"standing AS (SELECT item, uuid FROM ({SQL['apply_plan_selections']}) WHERE action IN ('create', 'map', 'skip_applied'))"
_ON_SELECTIONS = f"""SELECT 'apply_selection_notes' AS stage, CAST(item AS VARCHAR) AS item, key, action FROM (WITH {decisions._SELECTIONS}, {_STANDING},
    n AS (SELECT ls.item, rs.uuid, rs.uuid || ':n' AS key, rs.part FROM rs JOIN ls USING (uuid) WHERE rs.part % 5 <> 4 AND NOT rs.deleted)
    SELECT n.item, key, CASE WHEN part % 3 = 0 THEN 'skip_own' WHEN standing.uuid IS NULL THEN 'no_parent' WHEN part % 7 = 0 THEN 'skip_present' WHEN part % 7 = 1 THEN 'update' ELSE 'create' END AS action FROM n LEFT JOIN standing ON standing.uuid = n.uuid AND standing.item = n.item)
  UNION ALL SELECT 'apply_selection_metadata', NULL, uuid || ':' || prop, action FROM (WITH {decisions._SELECTION_FIELDS}, {_STANDING}, here AS (SELECT uuid AS subject FROM standing), l AS (SELECT * FROM lf WHERE part % 7 <> 0)
    SELECT uuid, prop, {decisions._APPLY_FIELD} FROM rf r LEFT JOIN here h ON h.subject = r.uuid LEFT JOIN l USING (uuid, prop) LEFT JOIN pf p USING (uuid, prop))"""


@query(f"{_told(_APPLIED | _PUSHED)} UNION ALL {_ON_SELECTIONS}")
def cycle_plan(spark, sf_dir):
    """All stages of a cycle, with every option on."""
    config = SyncConfig(user_id=ME, sync_lists=True, sync_photo_adjustments=True)
    return cycle.Cycles(spark, _folder(spark, "cycles")).run(1, stages(spark, sf_dir), config)


@query(_told({name: told for name, told in _PUSHED.items() if name not in ("push_photos", "push_selection_metadata")}))
def cycle_push(spark, sf_dir):
    """A cycle of a replica that only pushes, with the options as they come: nothing that applies is planned."""
    return cycle.Cycles(spark, _folder(spark, "cycles")).run(1, stages(spark, sf_dir), SyncConfig(user_id=ME, mode="push"))


_HOST = ", ".join(f"('{stage}', '{action}', {step}, '{name}')" for (stage, action), names in writes.HOST_ACTIONS.items() for step, name in enumerate(names, 1))


@query(f"SELECT c.stage, c.item, c.key, h.step, h.type FROM ({SQL['cycle_plan']}) c JOIN (VALUES {_HOST}) h(stage, action, step, type) ON c.stage = h.stage AND c.action = h.action")
def cycle_actions(spark, sf_dir):
    """What a host is asked to do by a whole cycle, over all sections."""
    return writes.host_actions(cycle_plan(spark, sf_dir))


# --- items ---------------------------------------------------------------------------------------


@query(f"""WITH {_OPS}, {_PHOTOS}, t AS (SELECT CAST(substr(identity, 5) AS BIGINT) AS local_id, section, key FROM ops WHERE section IN ('tags', 'lists') AND NOT deleted)
  SELECT o_orderkey AS local_id, o_orderpriority AS template, coalesce((SELECT string_agg(checksum, ',' ORDER BY ordinal, checksum) FROM photos p WHERE p.local_id = o_orderkey), '') AS photos,
    coalesce((SELECT string_agg(DISTINCT key, ',' ORDER BY key) FROM t WHERE t.local_id = o_orderkey AND section = 'tags'), '') AS tags, coalesce((SELECT string_agg(DISTINCT key, ',' ORDER BY key) FROM t WHERE t.local_id = o_orderkey AND section = 'lists'), '') AS lists FROM orders""")
def item_summaries(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_id"), F.col("o_orderpriority").alias("template"))
    ops = P.ops(spark, sf_dir).filter("not deleted").select(F.substring("identity", 5, 20).cast("long").alias("local_id"), "section", F.col("key").alias("id"))
    of = lambda s: ops.filter(F.col("section") == s).select("local_id", "id")
    d = items.summaries(o, P.photos(spark, sf_dir).withColumnRenamed("checksum", "id"), of("tags"), of("lists"))
    return d.select("local_id", "template", *[F.array_join(c, ",").alias(c) for c in ("photos", "tags", "lists")])


_PROPS = """pr AS (SELECT 'cs' || p_partkey AS subject, 'brand' AS prop, p_brand AS text FROM part UNION ALL SELECT 'cs' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 's_' || doc_id, 'lang', lang FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus FROM orders WHERE o_orderkey % 2 = 0),
  mt AS (SELECT subject, string_agg(prop || '=' || text, ';' ORDER BY prop) AS meta FROM (SELECT subject, prop, max(text) AS text FROM pr GROUP BY ALL) GROUP BY 1)"""


@query(f"""WITH {_PROPS}, t AS ({SQL['item_tree']}), sl AS (SELECT 'cs' || (doc_id % 200) AS checksum, string_agg('s_' || doc_id || ':' || coalesce(meta, ''), ',' ORDER BY 's_' || doc_id) AS on_selections FROM documents LEFT JOIN mt ON subject = 's_' || doc_id GROUP BY 1)
  SELECT t.*, coalesce(a.meta, '') AS on_item, coalesce(b.meta, '') AS on_photo, coalesce(on_selections, '') AS on_selections FROM t LEFT JOIN mt a ON a.subject = CAST(t.local_id AS VARCHAR) LEFT JOIN mt b ON b.subject = t.checksum LEFT JOIN sl USING (checksum)""")
def item_documents(spark, sf_dir):
    """Whole items as one tree: metadata of items, photos and selections, tags, notes, transcriptions."""
    part, docs, orders = (P.read(spark, sf_dir, t) for t in ("part", "documents", "orders"))
    photo = F.concat(F.lit("cs"), "p_partkey")
    props = part.select(photo.alias("subject"), F.lit("brand").alias("prop"), F.col("p_brand").alias("text"))
    for more in (
        part.filter("p_partkey % 3 = 0").select(photo, F.lit("size"), F.col("p_size").cast("string")),
        docs.filter("doc_id % 4 = 0").select(F.concat(F.lit("s_"), "doc_id"), F.lit("lang"), "lang"),
        orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string"), F.lit("status"), "o_orderstatus"),
    ):
        props = props.union(more)
    d = decisions._tree(spark, sf_dir, props.withColumn("type", F.lit(graph.STRING)))
    told = lambda m: F.coalesce(F.array_join(F.transform(m, lambda p: F.concat(p["prop"], F.lit("="), p["text"])), ";"), F.lit(""))
    d = d.select("local_id", "title", F.array_join("tag", ",").alias("tags"), told(F.col("metadata")).alias("on_item"), F.inline("photo"))
    on = F.array_join(F.transform("selection", lambda s: F.concat(s["uuid"], F.lit(":"), told(s["metadata"]))), ",").alias("on_selections")
    return d.select("local_id", "title", "tags", "ordinal", "checksum", *decisions.flat_photo(), "on_item", told(F.col("metadata")).alias("on_photo"), on)


@query(f"WITH {_STATE} SELECT identity, section, key FROM state WHERE NOT deleted AND (section <> 'lists' OR clock % 3 <> 0)")
def active_members(spark, sf_dir):
    """Live entries; a membership in a list also has to say that the item is a member."""
    s = state.merge(P.ops(spark, sf_dir))
    return state.members(s, F.col("clock") % 3 != 0).select("identity", "section", "key")


# --- logs and hashes -----------------------------------------------------------------------------


@query(f"WITH {_OPS} SELECT * FROM ops")
def op_log(spark, sf_dir):
    """The log as a late reader finds it: all files, whoever added them when."""
    ops, at = P.ops(spark, sf_dir), _folder(spark, "log")
    for part in (0, 1):
        ops.filter(F.col("clock") % 2 == part).write.mode("append").parquet(at)
    return readers.op_log(spark, at).select(*ops.columns)


@query(f"WITH {_OPS} SELECT identity, section FROM ops WHERE author IS DISTINCT FROM 'u0'")
def remote_feed(spark, sf_dir):
    """What others changed, write by write."""
    return oplog.change_feed(P.ops(spark, sf_dir), ME)


@query(f"WITH {_STATE} SELECT identity, section, key, 'u0' AS author, CAST(77 AS BIGINT) AS clock, value, false AS deleted FROM state WHERE section = 'notes' AND NOT deleted")
def entry_upserts(spark, sf_dir):
    """Ops that write entries anew, and so win over what was there."""
    notes = state.live(state.merge(P.ops(spark, sf_dir))).filter("section = 'notes'")
    return writes.upserts(notes, ME, 77).drop("at")


@query("SELECT c_custkey AS id, lower(to_base(" + catalogue._fnv("c_name || c_mktsegment", FNV_SEEDS[0]) + ", 36)) AS hash FROM customer")
def fast_hashes(spark, sf_dir):
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fast_hash(F.concat("c_name", "c_mktsegment")).alias("hash"))
