"""Queries of the push and apply decisions of all sections, of scans, lookups, aliases and change feeds, each with
its twin in DuckDB's SQL. The other replica, and what was pushed or applied before, are tables of their own,
made from the driver's tables with changes by number; the operators join them."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalar, text
from palimpsest.operators import items, maintain, reconcile, report, sections, state, writes
from palimpsest.plans.catalogue import _CUT, _UNITS, _WRAP, _escape_sql, _LISTS, _OPS, _PHOTOS, _STATE, ME, _cutoff, _fnv_hex
from palimpsest.plans.registry import query
from palimpsest.session import written
from palimpsest.sources import projections as P
from palimpsest.sources import readers
from palimpsest.streaming import oplog

# --- notes ---------------------------------------------------------------------------------------

_FOOTER = "'<p><sub>[overlay:' || key || ' from ' || author || ' — safe to delete, do not edit]</sub></p>'"
_LOCAL_NOTES = f"""n0 AS (SELECT doc_id, 'n_' || doc_id AS key, text, 'u' || (doc_id % 5) AS author FROM documents),
  ln AS (SELECT doc_id, key, text, '<p>' || text || '</p>' || CASE WHEN doc_id % 7 = 3 THEN {_FOOTER} ELSE '' END AS html FROM n0),
  rn AS (SELECT key, CASE WHEN doc_id % 6 = 1 THEN 'their text' ELSE text END AS text, CASE WHEN doc_id % 6 = 1 THEN '<p>their text</p>' ELSE '<p>' || text || '</p>' END AS html, author, doc_id % 11 = 0 AS deleted,
    CASE WHEN doc_id % 10 <> 9 THEN 'cs' || (doc_id % 50) END AS photo FROM n0 WHERE doc_id % 3 <> 0),
  pn AS (SELECT key, CASE WHEN doc_id % 8 = 1 THEN 'older' ELSE html END AS html FROM ln WHERE doc_id % 4 <> 3)"""


def _notes(spark, sf_dir):
    """Local, remote and last pushed notes."""
    n = P.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n_"), "doc_id").alias("key"), "text", F.concat(F.lit("u"), F.col("doc_id") % 5).alias("author"))
    paragraph = lambda c: F.concat(F.lit("<p>"), c, F.lit("</p>"))
    local = n.withColumn("html", F.concat(paragraph(F.col("text")), F.when(F.col("doc_id") % 7 == 3, text.footer(F.col("key"), F.col("author"))).otherwise("")))
    theirs = F.when(F.col("doc_id") % 6 == 1, "their text").otherwise(F.col("text"))
    remote = n.filter("doc_id % 3 <> 0").select("key", theirs.alias("text"), "author", (F.col("doc_id") % 11 == 0).alias("deleted"), F.when(F.col("doc_id") % 10 != 9, F.concat(F.lit("cs"), F.col("doc_id") % 50)).alias("photo"))
    remote = remote.withColumn("html", paragraph(F.col("text")))
    pushed = local.filter("doc_id % 4 <> 3").select("key", F.when(F.col("doc_id") % 8 == 1, "older").otherwise(F.col("html")).alias("html"))
    return local, remote, pushed


@query(f"""WITH {_LOCAL_NOTES} SELECT key, CASE WHEN contains(ln.html, '[overlay:') OR contains(ln.text, '[overlay:') THEN 'skip_synced' WHEN coalesce(ln.text, '') = '' AND coalesce(ln.html, '') = '' THEN 'skip_empty'
  WHEN rn.key IS NOT NULL AND NOT rn.deleted AND ln.text IS NOT DISTINCT FROM rn.text AND ln.html IS NOT DISTINCT FROM rn.html THEN 'skip_equal'
  WHEN rn.key IS NOT NULL AND NOT rn.deleted AND rn.author <> 'u0' AND ln.html = pn.html THEN 'conflict_remote' ELSE 'push' END AS action
  FROM ln LEFT JOIN rn USING (key) LEFT JOIN pn USING (key)""")
def push_plan_notes(spark, sf_dir):
    local, remote, pushed = _notes(spark, sf_dir)
    empty = (F.coalesce("text", F.lit("")) == "") & (F.coalesce("html", F.lit("")) == "")
    skip = F.when(text.is_synchronised(F.col("text"), F.col("html")), "skip_synced").when(empty, "skip_empty")
    local = local.withColumn("html", text.normalize_html(F.col("html"))).withColumn("skip", skip).select("key", "text", "html", "skip")
    return sections.push_plan(local, remote, pushed.select("key", sections.content_hash(["html"]).alias("hash")), ["key"], ["text", "html"], ME, hashed=["html"])


#: Photos of items, one for each place; items of notes and transcriptions are orders of small numbers.
_ITEM_PHOTOS = f"{_PHOTOS}, ip AS (SELECT local_id AS item, ordinal, max(checksum) AS checksum FROM photos GROUP BY 1, 2)"
_NOTE_PLAN = f"""{_LOCAL_NOTES}, {_ITEM_PHOTOS}, first AS (SELECT item, arg_min(checksum, ordinal) AS first FROM ip GROUP BY item),
  an AS (SELECT doc_id % 500 AS item, key, author, CASE WHEN doc_id % 6 = 1 THEN 'their text' ELSE text END AS text,
      CASE WHEN doc_id % 6 = 1 THEN '<p>their text</p>' WHEN doc_id % 6 = 4 THEN '<p>' || {_escape_sql("text")} || '</p>' ELSE '<p>' || text || '</p>' END AS safe,
      CASE WHEN doc_id % 10 = 8 THEN 'cs' || (doc_id % 50) WHEN doc_id % 10 <> 9 THEN checksum END AS photo
    FROM n0 LEFT JOIN ip ON item = doc_id % 500 AND ordinal = 1 + doc_id % 3 WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0),
  rp AS (SELECT an.*, safe || {_FOOTER} AS content, CASE WHEN photo IS NULL THEN first WHEN EXISTS (SELECT 1 FROM ip WHERE ip.item = an.item AND checksum = photo) THEN photo END AS parent FROM an LEFT JOIN first USING (item)),
  mine AS (SELECT (doc_id + CASE WHEN doc_id % 8 = 6 THEN 1 ELSE 0 END) % 500 AS item, CASE WHEN doc_id % 4 = 1 THEN key END AS key, CASE WHEN doc_id % 8 = 5 THEN '[retracted] ' || text WHEN doc_id % 16 = 9 THEN 'mine' ELSE text END AS text,
      '<p>' || CASE WHEN doc_id % 32 = 9 THEN 'edited' ELSE text END || '</p>' AS html FROM n0 WHERE doc_id % 4 IN (1, 2)),
  applied AS (SELECT key, '<p>' || text || '</p>' AS html FROM n0 WHERE doc_id % 4 = 1),
  forms AS (SELECT DISTINCT item, trim(f) AS f FROM (SELECT item, unnest([text, regexp_replace(text, '^\\[(?:overlay:)?[^\\]]{{1,80}}\\]\\s*', ''), html]) AS f FROM mine) WHERE trim(f) <> ''),
  plan AS (SELECT rp.item, rp.key, parent, content, CASE WHEN author = 'u0' THEN 'skip_own' WHEN coalesce(rp.text, '') = '' AND safe = '<p></p>' THEN 'skip_empty'
      WHEN m.key IS NOT NULL AND rp.text <> '' AND contains(m.text, rp.text) AND NOT contains(m.text, '[retracted') THEN 'skip_present' WHEN parent IS NULL THEN 'no_parent'
      WHEN m.key IS NOT NULL AND a.html <> m.html THEN 'conflict_local' WHEN m.key IS NOT NULL THEN 'update'
      WHEN EXISTS (SELECT 1 FROM forms WHERE forms.item = rp.item AND f IN (trim(safe), trim(content), trim(rp.text))) THEN 'dedup' ELSE 'create' END AS action
    FROM rp LEFT JOIN mine m USING (key) LEFT JOIN applied a USING (key))"""


def _item_photos(spark, sf_dir, asked):
    """Photos of the items that are asked for. The items are written first, so that few of them are joined without a
    shuffle, and the photos, because a plan needs them several times."""
    asked = written(asked.distinct(), "asked-items").withColumnRenamed("item", "local_id")
    photos = P.photos(spark, sf_dir).join(asked, "local_id", "left_semi")
    return written(photos.groupBy(F.col("local_id").alias("item"), "ordinal").agg(F.max("checksum").alias("checksum")), "item-photos")


def _note_application(spark, sf_dir):
    """The plan of the other replica's notes, and what was applied before. Some of its html is unsafe or missing; some of
    our own notes equal one of theirs on another item."""
    n = P.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n_"), "doc_id").alias("key"), "text", F.concat(F.lit("u"), F.col("doc_id") % 5).alias("author"))
    number, photos = F.col("doc_id"), _item_photos(spark, sf_dir, n.select((F.col("doc_id") % 500).alias("item")))
    paragraph = lambda c: F.concat(F.lit("<p>"), c, F.lit("</p>"))
    unsafe = F.concat(F.lit('<p onclick="take()">'), "text", F.lit("</p><script>take()</script>"))
    placed = n.filter("doc_id % 3 <> 0 AND doc_id % 11 <> 0").withColumn("item", number % 500).withColumn("ordinal", number % 3 + 1).join(photos, ["item", "ordinal"], "left")
    html = F.when(number % 6 == 1, "<p>their text</p>").when(number % 6 == 2, unsafe).when(number % 6 != 4, paragraph(F.col("text")))
    photo = F.when(number % 10 == 8, F.concat(F.lit("cs"), number % 50)).when(number % 10 != 9, F.col("checksum"))
    remote = placed.select("item", "key", F.when(number % 6 == 1, "their text").otherwise(F.col("text")).alias("text"), html.alias("html"), photo.alias("photo"), "author")
    mine = n.filter("doc_id % 4 in (1, 2)").select(
        ((number + F.when(number % 8 == 6, 1).otherwise(0)) % 500).alias("item"),
        F.when(number % 4 == 1, F.col("key")).alias("key"),
        F.when(number % 8 == 5, F.concat(F.lit("[retracted] "), "text")).when(number % 16 == 9, "mine").otherwise(F.col("text")).alias("text"),
        paragraph(F.when(number % 32 == 9, "edited").otherwise(F.col("text"))).alias("html"),
    )
    applied = n.filter("doc_id % 4 = 1").select("key", reconcile.field_hash(paragraph(F.col("text")), "note").alias("hash"), F.lit(1).cast("long").alias("cycle"))
    return sections.note_plan(remote, mine, applied, photos, ME), applied


@query(f"WITH {_NOTE_PLAN} SELECT item, key, action, CASE WHEN action IN ('update', 'create') THEN parent END AS parent, CASE WHEN action IN ('update', 'create') THEN content END AS html FROM plan")
def apply_plan_notes(spark, sf_dir):
    return _note_application(spark, sf_dir)[0]


@query(f"""WITH {_NOTE_PLAN}, done AS (SELECT key, CASE WHEN action IN ('update', 'create') THEN left(sha256(content || '|note'), 16) END AS now FROM plan WHERE action NOT IN ('skip_own', 'skip_empty', 'no_parent'))
  SELECT coalesce(d.key, a.key) AS key, coalesce(d.now, left(sha256(a.html || '|note'), 16)) AS hash, CAST(CASE WHEN d.now IS NOT NULL OR a.key IS NULL THEN 2 ELSE 1 END AS BIGINT) AS cycle FROM done d FULL JOIN applied a ON a.key = d.key""")
def note_hashes(spark, sf_dir):
    plan, applied = _note_application(spark, sf_dir)
    return sections.applied_notes(plan, applied, 2)


@query(f"""WITH {_PHOTOS}, n AS (SELECT 'n_' || doc_id AS uuid, doc_id % 500 AS item, 'cs' || (doc_id % 50) AS photo FROM documents)
  SELECT uuid, CASE WHEN EXISTS (SELECT 1 FROM photos WHERE local_id = item AND checksum = photo) THEN photo ELSE (SELECT arg_min(checksum, struct_pack(o := ordinal, c := checksum)) FROM photos WHERE local_id = item) END AS parent FROM n""")
def note_first_photo(spark, sf_dir):
    notes = P.notes(spark, sf_dir).select("uuid", (F.col("doc_id") % 500).alias("item"), "photo")
    return sections.first_photo(notes, P.photos(spark, sf_dir).withColumnRenamed("local_id", "item"))


# --- metadata of photos and selections -----------------------------------------------------------

_PARTS = """lm AS (SELECT p_partkey, 'cs' || p_partkey AS photo, unnest(['brand', 'type', 'size']) AS prop, unnest([p_brand, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_type END, CAST(p_size AS VARCHAR)]) AS text FROM part),
  rm AS (SELECT photo, prop, CASE WHEN p_partkey % 4 = 2 THEN text || ' (theirs)' ELSE text END AS text, 'u' || (p_partkey % 3) AS author FROM lm WHERE p_partkey % 5 <> 0),
  pm AS (SELECT photo, prop, CASE WHEN p_partkey % 8 = 0 THEN 'older' ELSE text END AS text FROM lm WHERE p_partkey % 2 = 0)"""


def _parts(spark, sf_dir):
    p = P.read(spark, sf_dir, "part")
    props = F.array(
        F.struct(F.lit("brand").alias("prop"), F.col("p_brand").alias("text")),
        F.struct(F.lit("type").alias("prop"), F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("p_type")).alias("text")),
        F.struct(F.lit("size").alias("prop"), F.col("p_size").cast("string").alias("text")),
    )
    local = p.select("p_partkey", F.concat(F.lit("cs"), "p_partkey").alias("photo"), F.inline(props))
    remote = local.filter("p_partkey % 5 <> 0").select("photo", "prop", F.when(F.col("p_partkey") % 4 == 2, F.concat("text", F.lit(" (theirs)"))).otherwise(F.col("text")).alias("text"), F.concat(F.lit("u"), F.col("p_partkey") % 3).alias("author"))
    pushed = local.filter("p_partkey % 2 = 0").withColumn("text", F.when(F.col("p_partkey") % 8 == 0, "older").otherwise(F.col("text"))).select("photo", "prop", sections.content_hash(["text"]).alias("hash"))
    return local, remote, pushed


_PUSH_FIELD = """CASE WHEN coalesce(l.text, '') = '' AND r.text IS NULL THEN 'skip_empty' WHEN r.author IS NOT NULL AND l.text IS NOT DISTINCT FROM r.text THEN 'skip_equal'
  WHEN r.author <> 'u0' AND l.text = p.text THEN 'conflict_remote' ELSE 'push' END AS action"""
_APPLY_FIELD = """CASE WHEN r.author = 'u0' THEN 'skip_own' WHEN h.subject IS NULL THEN 'no_parent' WHEN l.text IS NULL THEN 'apply' WHEN l.text = coalesce(r.text, '') THEN 'skip_equal'
  WHEN p.text IS NULL OR p.text <> l.text THEN 'conflict_local' ELSE 'apply' END AS action"""


def _push_fields(local, remote, pushed, keys):
    known = remote.select(*keys, F.col("text").isNotNull().alias("known"))
    local = local.join(known, keys, "left").withColumn("skip", F.when((F.coalesce("text", F.lit("")) == "") & ~F.coalesce("known", F.lit(False)), "skip_empty"))
    return sections.push_plan(local.select(*keys, "text", "skip"), remote.withColumn("deleted", F.lit(False)), pushed, keys, ["text"], ME)


@query(f"WITH {_PARTS} SELECT photo, prop, {_PUSH_FIELD} FROM lm l LEFT JOIN rm r USING (photo, prop) LEFT JOIN pm p USING (photo, prop)")
def push_plan_photos(spark, sf_dir):
    return _push_fields(*_parts(spark, sf_dir), ["photo", "prop"])


@query(f"""WITH {_PARTS}, here AS (SELECT DISTINCT 'cs' || l_partkey AS subject FROM lineitem WHERE l_quantity > 40), l AS (SELECT * FROM lm WHERE p_partkey % 7 <> 0)
  SELECT photo, prop, {_APPLY_FIELD} FROM rm r LEFT JOIN here h ON h.subject = r.photo LEFT JOIN l USING (photo, prop) LEFT JOIN pm p USING (photo, prop)""")
def apply_plan_photos(spark, sf_dir):
    local, remote, pushed = _parts(spark, sf_dir)
    here = P.read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.concat(F.lit("cs"), "l_partkey").alias("photo"))
    return sections.apply_fields(remote, here, local.filter("p_partkey % 7 <> 0"), pushed, ["photo", "prop"], ME)


_SELECTIONS = """ls AS (SELECT 's_' || l_orderkey || '_' || l_linenumber AS uuid, max(l_orderkey) AS item, max(l_partkey) AS part, 'u' || max(l_suppkey % 5) AS author, max(l_quantity) AS x, max(l_extendedprice) / 1000 AS y, max(l_discount) * 100 AS w, max(l_tax) * 100 AS h, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1),
  rs AS (SELECT uuid, part, author, CASE WHEN part % 4 = 1 THEN x + 1 ELSE x END AS x, y, w, h, part % 13 = 0 AS deleted FROM ls WHERE part % 3 <> 0),
  ps AS (SELECT uuid, CASE WHEN part % 6 = 1 THEN x - 1 ELSE x END AS x, y, w, h FROM ls WHERE part % 5 <> 0)"""


def _selection_rows(spark, sf_dir):
    """Selections, of rows with the same number the largest values."""
    return P.read(spark, sf_dir, "lineitem").groupBy(F.concat_ws("_", F.lit("s"), "l_orderkey", "l_linenumber").alias("uuid")).agg(
        F.max("l_orderkey").alias("item"), F.max("l_partkey").alias("part"), F.concat(F.lit("u"), F.max(F.col("l_suppkey") % 5)).alias("author"), F.max("l_quantity").alias("x"), (F.max("l_extendedprice") / 1000).alias("y"),
        (F.max("l_discount") * 100).alias("w"), (F.max("l_tax") * 100).alias("h"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"),
    )


def _selections(spark, sf_dir, rows=None):
    """Local, remote and last pushed selections."""
    d = _selection_rows(spark, sf_dir) if rows is None else rows
    remote = d.filter("part % 3 <> 0").withColumn("x", F.when(F.col("part") % 4 == 1, F.col("x") + 1).otherwise(F.col("x"))).withColumn("deleted", F.col("part") % 13 == 0)
    pushed = d.filter("part % 5 <> 0").withColumn("x", F.when(F.col("part") % 6 == 1, F.col("x") - 1).otherwise(F.col("x")))
    return d, remote, pushed.select("uuid", sections.content_hash(["x", "y", "w", "h"]).alias("hash"))


@query(f"""WITH {_SELECTIONS} SELECT uuid, CASE WHEN r.uuid IS NOT NULL AND NOT r.deleted AND l.x = r.x AND l.y = r.y AND l.w = r.w AND l.h = r.h THEN 'skip_equal'
  WHEN r.uuid IS NOT NULL AND NOT r.deleted AND r.author <> 'u0' AND l.x = p.x AND l.y = p.y AND l.w = p.w AND l.h = p.h THEN 'conflict_remote' ELSE 'push' END AS action
  FROM ls l LEFT JOIN rs r USING (uuid) LEFT JOIN ps p USING (uuid)""")
def push_plan_selections(spark, sf_dir, rows=None):
    local, remote, pushed = _selections(spark, sf_dir, rows)
    local = local.select("uuid", "x", "y", "w", "h", F.lit(None).cast("string").alias("skip"))
    return sections.push_plan(local, remote, pushed, ["uuid"], ["x", "y", "w", "h"], ME)


_SELECTION_FIELDS = f"""{_SELECTIONS}, lf AS (SELECT uuid, part, author, unnest(['flag', 'status']) AS prop, unnest([flag, status]) AS text FROM ls),
  rf AS (SELECT uuid, prop, CASE WHEN part % 4 = 3 THEN text || '!' ELSE text END AS text, author FROM lf WHERE part % 3 <> 0), pf AS (SELECT uuid, prop, CASE WHEN part % 8 = 3 THEN '?' ELSE text END AS text FROM lf WHERE part % 5 <> 0)"""


def _selection_fields(spark, sf_dir, rows=None):
    d = _selections(spark, sf_dir, rows)[0]
    local = d.select("uuid", "part", "author", F.inline(F.array(*[F.struct(F.lit(c).alias("prop"), F.col(c).alias("text")) for c in ("flag", "status")])))
    remote = local.filter("part % 3 <> 0").select("uuid", "prop", F.when(F.col("part") % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "author")
    pushed = local.filter("part % 5 <> 0").withColumn("text", F.when(F.col("part") % 8 == 3, "?").otherwise(F.col("text"))).select("uuid", "prop", sections.content_hash(["text"]).alias("hash"))
    return local, remote, pushed


@query(f"WITH {_SELECTION_FIELDS} SELECT uuid, prop, {_PUSH_FIELD} FROM lf l LEFT JOIN rf r USING (uuid, prop) LEFT JOIN pf p USING (uuid, prop)")
def push_plan_selection_metadata(spark, sf_dir, rows=None):
    return _push_fields(*_selection_fields(spark, sf_dir, rows), ["uuid", "prop"])


@query(f"""WITH {_SELECTION_FIELDS}, here AS (SELECT uuid AS subject FROM ls WHERE x > 10), l AS (SELECT * FROM lf WHERE part % 7 <> 0)
  SELECT uuid, prop, {_APPLY_FIELD} FROM rf r LEFT JOIN here h ON h.subject = r.uuid LEFT JOIN l USING (uuid, prop) LEFT JOIN pf p USING (uuid, prop)""")
def apply_plan_selection_metadata(spark, sf_dir):
    local, remote, pushed = _selection_fields(spark, sf_dir)
    here = _selections(spark, sf_dir)[0].filter("x > 10").select("uuid")
    return sections.apply_fields(remote, here, local.filter("part % 7 <> 0"), pushed, ["uuid", "prop"], ME)


_PLACE = "photo || ':' || CAST(floor(x + 0.5) AS BIGINT) || ':' || CAST(floor(y + 0.5) AS BIGINT) || ':' || CAST(floor(w + 0.5) AS BIGINT) || ':' || CAST(floor(h + 0.5) AS BIGINT)"


@query(f"""WITH {_SELECTIONS}, here AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS photo FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 40), done AS (SELECT uuid FROM ps WHERE x > 25),
  mine AS (SELECT DISTINCT item, {_PLACE} AS fp FROM (SELECT *, part AS photo FROM ls) WHERE author IN ('u0', 'u1')),
  theirs AS (SELECT rs.*, ls.item, CASE WHEN rs.part % 7 = 0 THEN rs.part + 1 ELSE rs.part END AS photo FROM rs JOIN ls USING (uuid))
  SELECT item, uuid, CASE WHEN deleted THEN 'skip_deleted' WHEN author = 'u0' THEN 'skip_own' WHEN uuid IN (SELECT uuid FROM done) THEN 'skip_applied' WHEN NOT (w > 0 AND h > 0) THEN 'skip_invalid'
  WHEN NOT EXISTS (SELECT 1 FROM here WHERE here.item = theirs.item AND here.photo = theirs.photo) THEN 'no_parent' WHEN EXISTS (SELECT 1 FROM mine WHERE mine.item = theirs.item AND fp = {_PLACE.replace("photo", "theirs.photo")}) THEN 'map' ELSE 'create' END AS action FROM theirs""")
def apply_plan_selections(spark, sf_dir, rows=None):
    local, remote, _ = _selections(spark, sf_dir, rows)
    place = F.concat_ws(":", F.col("photo").cast("string"), *[scalar.round_half_up(F.col(c)).cast("string") for c in "xywh"])
    parts = P.read(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("photo"))
    here = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("photo")).join(parts, "photo", "left_semi")
    done = local.filter("part % 5 <> 0").filter(F.when(F.col("part") % 6 == 1, F.col("x") - 1).otherwise(F.col("x")) > 25).select("uuid")
    mine = local.filter("author in ('u0', 'u1')").withColumn("photo", F.col("part")).select("item", place.alias("fp"))
    remote = remote.withColumn("photo", F.when(F.col("part") % 7 == 0, F.col("part") + 1).otherwise(F.col("part"))).withColumn("fp", place)
    return sections.selection_plan(remote, scalar.valid_rectangle(*[F.col(c) for c in "xywh"]), here, done, mine, ME)


# --- transcriptions, lists -----------------------------------------------------------------------

_TRANSCRIPTS = """lt AS (SELECT 't_' || conv_id || '_' || turn AS uuid, conv_id, turn, max(text) AS text FROM conversations GROUP BY ALL),
  rt AS (SELECT uuid, conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN 'theirs' ELSE text END AS text, 'u' || (conv_id % 3) AS author, conv_id % 11 = 0 AS deleted FROM lt WHERE turn % 3 <> 2),
  pt AS (SELECT uuid, text FROM lt WHERE conv_id % 2 = 1)"""
#: Longer transcriptions are not pushed; the option's default is far larger than the texts at hand.
LARGE = 200


def _transcripts(spark, sf_dir):
    d = P.transcriptions(spark, sf_dir).groupBy("uuid", "conv_id", "turn").agg(F.max("text").alias("text"))
    remote = d.filter("turn % 3 <> 2").select("uuid", "turn", F.when(F.col("conv_id") % 4 == 1, "theirs").otherwise(F.col("text")).alias("text"), F.concat(F.lit("u"), F.col("conv_id") % 3).alias("author"), (F.col("conv_id") % 11 == 0).alias("deleted"), "conv_id")
    return d, remote, d.filter("conv_id % 2 = 1").select("uuid", "text")


@query(f"""WITH {_TRANSCRIPTS} SELECT uuid, CASE WHEN length(l.text) > {LARGE} THEN 'skip_oversize' WHEN r.uuid IS NOT NULL AND NOT r.deleted AND l.text IS NOT DISTINCT FROM r.text THEN 'skip_equal'
  WHEN r.uuid IS NOT NULL AND NOT r.deleted AND r.author <> 'u0' AND l.text = p.text THEN 'conflict_remote' ELSE 'push' END AS action FROM lt l LEFT JOIN rt r USING (uuid) LEFT JOIN pt p USING (uuid)""")
def push_plan_transcriptions(spark, sf_dir):
    local, remote, pushed = _transcripts(spark, sf_dir)
    local = local.select("uuid", "text", F.when(F.length("text") > LARGE, "skip_oversize").alias("skip"))
    return sections.push_plan(local, remote, pushed.select("uuid", sections.content_hash(["text"]).alias("hash")), ["uuid"], ["text"], ME)


@query(f"""WITH {_TRANSCRIPTS}, {_ITEM_PHOTOS}, done AS (SELECT uuid FROM lt WHERE turn % 5 = 3),
  theirs AS (SELECT rt.*, conv_id % 500 AS item, CASE WHEN conv_id % 5 = 0 THEN 'cs' || (conv_id * 7 % 60) ELSE checksum END AS photo FROM rt LEFT JOIN ip ON ip.item = conv_id % 500 AND ordinal = 1 + turn % 4)
  SELECT item, uuid, CASE WHEN deleted THEN 'skip_deleted' WHEN author = 'u0' THEN 'skip_own' WHEN coalesce(text, '') = '' THEN 'skip_empty' WHEN uuid IN (FROM done) THEN 'skip_applied'
  WHEN NOT EXISTS (SELECT 1 FROM ip WHERE ip.item = theirs.item AND checksum = photo) THEN 'no_parent' WHEN uuid IN (SELECT uuid FROM pt) THEN 'replace' ELSE 'create' END AS action FROM theirs""")
def apply_plan_transcriptions(spark, sf_dir):
    local, remote, pushed = _transcripts(spark, sf_dir)
    photos = _item_photos(spark, sf_dir, remote.select((F.col("conv_id") % 500).alias("item")))
    remote = remote.withColumn("item", F.col("conv_id") % 500).withColumn("ordinal", F.col("turn") % 4 + 1).join(photos, ["item", "ordinal"], "left")
    remote = remote.withColumn("photo", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("cs"), F.col("conv_id") * 7 % 60)).otherwise(F.col("checksum")))
    return sections.transcription_plan(remote, photos.select("item", F.col("checksum").alias("photo")), local.filter("turn % 5 = 3"), pushed, ME)


_MEMBERS = ", theirs AS (SELECT identity, p_name AS name, author, deleted FROM state JOIN part ON CAST(substr(key, 2) AS BIGINT) = p_partkey WHERE section = 'lists'), here AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 10), members AS (SELECT DISTINCT identity, p_name AS name FROM ops JOIN part ON CAST(substr(key, 2) AS BIGINT) = p_partkey WHERE section = 'lists' AND author = 'u2')"


@query(f"""WITH {_STATE}{_MEMBERS} SELECT identity, name, CASE WHEN NOT deleted AND m.identity IS NULL THEN 'add' WHEN deleted AND m.identity IS NOT NULL THEN 'remove' ELSE 'skip' END AS action
  FROM theirs LEFT JOIN members m USING (identity, name) WHERE author <> 'u0' AND name IN (FROM here)""")
def apply_plan_lists(spark, sf_dir):
    p = P.read(spark, sf_dir, "part")
    names = p.select(F.concat(F.lit("k"), "p_partkey").alias("key"), F.col("p_name").alias("name"))
    ops = P.ops(spark, sf_dir).filter("section = 'lists'")
    members = ops.filter("author = 'u2'").join(names, "key")
    return sections.list_membership_plan(state.merge(ops).join(names, "key"), p.filter("p_size > 10").select(F.col("p_name").alias("name")), members, ME)


# --- scans and lookups ---------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN 'c' || n_regionkey END AS color FROM nation")
def tag_scan(spark, sf_dir):
    color = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("c"), "n_regionkey")).otherwise("")
    return P.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.nullif(color, F.lit("")).alias("color"))


@query(f"WITH {_LISTS} SELECT uuid AS id, name, parent FROM nodes")
def list_scan(spark, sf_dir):
    return P.list_nodes(spark, sf_dir).select(F.col("uuid").alias("id"), "name", "parent")


@query("SELECT upper(substr(s_name, 1, 12)) || c_nationkey AS name, (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(upper(substr(s_name, 1, 12)) || c_nationkey)) AS local_id FROM supplier JOIN customer ON s_nationkey = c_nationkey UNION SELECT upper(n_name), (SELECT min(m.n_nationkey) FROM nation m WHERE lower(m.n_name) = lower(nation.n_name)) FROM nation")
def tag_lookup(spark, sf_dir):
    s, c, n = (P.read(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    nations = c.select("c_nationkey").distinct()
    asked = s.join(nations, F.col("s_nationkey") == F.col("c_nationkey")).select(F.concat(F.upper(F.substring("s_name", 1, 12)), "c_nationkey").alias("name"))
    return sections.lookup(asked.union(n.select(F.upper("n_name"))), n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("local_id")), fold=True)


@query(f"WITH {_LISTS}, asked AS (SELECT name FROM nodes UNION SELECT lower(name) FROM nodes) SELECT name, (SELECT min(ordinal) FROM nodes n WHERE n.name = asked.name) AS local_id FROM asked")
def list_lookup(spark, sf_dir):
    n = P.list_nodes(spark, sf_dir)
    return sections.lookup(n.select("name").union(n.select(F.lower("name"))), n.select("name", F.col("ordinal").alias("local_id")), fold=False)


@query(f"WITH {_PHOTOS} SELECT DISTINCT local_id, checksum FROM photos")
def photo_checksums(spark, sf_dir):
    return P.photos(spark, sf_dir).select("local_id", "checksum").distinct()


@query("SELECT c_custkey AS id, " + _fnv_hex("('note:' || CASE WHEN c_custkey % 4 = 0 THEN 'orphan' ELSE 'p' || c_nationkey END || ':' || left(t, 200) || ':' || CASE WHEN length(t) > 200 THEN left(" + _fnv_hex("t") + ", 8) ELSE '' END)") + " AS key FROM (SELECT *, repeat(c_name, CAST(1 + c_custkey % 15 AS INT)) AS t FROM customer)")
def note_keys(spark, sf_dir):
    d = P.read(spark, sf_dir, "customer").withColumn("t", F.repeat("c_name", (1 + F.col("c_custkey") % 15).cast("int")))
    return d.select(F.col("c_custkey").alias("id"), scalar.note_key(F.col("t"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("p"), "c_nationkey"))).alias("key"))


@query("SELECT c_custkey AS id, " + _fnv_hex("('tx:cs' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ':s' || c_custkey ELSE '' END || ':' || (c_custkey % 4))") + " AS key FROM customer")
def transcription_keys(spark, sf_dir):
    selection = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("s"), "c_custkey"))
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalar.transcription_key(F.concat(F.lit("cs"), "c_nationkey"), (F.col("c_custkey") % 4).cast("string"), selection).alias("key"))


# --- writes, aliases, maintenance ----------------------------------------------------------------


@query(f"""WITH {_LISTS} SELECT uuid AS key, 'u0' AS author, CAST(7 AS BIGINT) AS clock, CAST(NULL AS VARCHAR) AS value, true AS deleted FROM nodes WHERE ordinal % 2 = 0""")
def list_tombstones(spark, sf_dir):
    gone = P.list_nodes(spark, sf_dir).filter("ordinal % 2 = 0").select(F.lit("room").alias("identity"), F.lit("lists").alias("section"), F.col("uuid").alias("key"))
    return writes.tombstones(gone, ME, 7, 0).select("key", "author", "clock", "value", "deleted")


_ALIASES = """, links AS (SELECT identity, 'item' || (CAST(substr(key, 2) AS BIGINT) % 50 + 10000) AS old_identity, 'item' || (CAST(substr(key, 2) AS BIGINT) % 400) AS target, clock, CASE WHEN clock % 7 <> 0 THEN "at" END AS created FROM ops WHERE section = 'notes'),
  al AS (SELECT identity, old_identity, target, created FROM links QUALIFY row_number() OVER (PARTITION BY identity, old_identity ORDER BY clock DESC) = 1)"""


def _aliases(ops):
    """Aliases by their last write; one in seven is of the first format, without time."""
    n = F.substring("key", 2, 20).cast("long")
    links = ops.filter("section = 'notes'").select("identity", F.concat(F.lit("item"), n % 50 + 10000).alias("old_identity"), F.concat(F.lit("item"), n % 400).alias("target"), "clock", F.when(F.col("clock") % 7 != 0, F.col("at")).alias("created"))
    return sections.aliases(links)


@query(f"WITH {_OPS}{_ALIASES} SELECT * FROM al")
def alias_write(spark, sf_dir):
    return _aliases(P.ops(spark, sf_dir))


@query(f"WITH {_OPS}{_CUT}{_ALIASES} SELECT al.* FROM al, cut WHERE created IS NULL OR created < t")
def purge_aliases(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    return sections.purged_aliases(_aliases(ops), _cutoff(ops), server=True)


@query(f"""WITH {_STATE}{_CUT}{_ALIASES}, gone AS (SELECT state.* FROM state, cut WHERE deleted AND (deleted_at IS NULL OR deleted_at < t)), left_ AS (SELECT * FROM state WHERE (identity, section, key) NOT IN (SELECT identity, section, key FROM gone))
  SELECT mode, (SELECT count(DISTINCT identity) FROM state) AS items, purged, uuids, aliases FROM (
    SELECT 'all' AS mode, (SELECT count(*) FROM state WHERE deleted) AS purged, (SELECT count(*) FROM (SELECT DISTINCT identity, key FROM ops) WHERE (identity, key) NOT IN (SELECT identity, key FROM state WHERE NOT deleted)) AS uuids, (SELECT count(*) FROM al) AS aliases
    UNION ALL SELECT 'older', (SELECT count(*) FROM gone), (SELECT count(*) FROM (SELECT DISTINCT identity, key FROM ops) WHERE (identity, key) NOT IN (SELECT identity, key FROM left_)), (SELECT count(*) FROM al, cut WHERE created IS NULL OR created < t))""")
def purge_totals(spark, sf_dir):
    """What a client's purge of all tombstones and aliases, and one of those before a cutoff, remove."""
    ops = P.ops(spark, sf_dir)
    s, registry = state.merge(ops), ops.select("identity", "key").distinct()
    figures = []
    for mode, cutoff in (("all", None), ("older", _cutoff(ops))):
        plan = maintain.purge_plan(s, cutoff)
        uuids = maintain.orphans(registry, s, plan).agg(F.count(F.lit(1)).alias("uuids"))
        lost = sections.purged_aliases(_aliases(ops), cutoff).agg(F.count(F.lit(1)).alias("aliases"))
        each = maintain.purge_stats(s, plan).unionByName(uuids, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
        figures.append(each.agg(*[F.max(c).alias(c) for c in each.columns]).withColumn("mode", F.lit(mode)))
    return figures[0].unionByName(figures[1])


@query(f"WITH {_OPS}, first AS (SELECT identity, key, arg_min(section, clock) AS section FROM ops WHERE section <> 'tags' GROUP BY 1, 2) SELECT identity, CASE section WHEN 'notes' THEN 'note' WHEN 'selections' THEN 'selection' WHEN 'selectionNotes' THEN 'selectionNote' WHEN 'transcriptions' THEN 'transcription' ELSE 'list' END AS type, string_agg(key, ',' ORDER BY key) AS keys FROM first GROUP BY 1, 2")
def recovered_keys(spark, sf_dir):
    d = writes.registry(P.ops(spark, sf_dir)).groupBy("identity", "type").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return d.withColumn("keys", F.array_join("keys", ","))


@query(f"WITH {_OPS}, k AS (SELECT DISTINCT key FROM ops WHERE section = 'notes') SELECT key, CASE WHEN CAST(substr(key, 2) AS BIGINT) % 3 = 0 THEN 'local' || key ELSE 'n_' || substr(sha256(key), 1, 32) END AS id, CAST(substr(key, 2) AS BIGINT) % 3 <> 0 AS created FROM k")
def id_assign(spark, sf_dir):
    keys = P.ops(spark, sf_dir).filter("section = 'notes'").select("key").distinct()
    known = keys.filter(F.substring("key", 2, 20).cast("long") % 3 == 0).select("key", F.concat(F.lit("local"), "key").alias("id"))
    return sections.assign_ids(keys, known, "n_")


# --- changes -------------------------------------------------------------------------------------


@query(f"WITH {_OPS} SELECT DISTINCT identity FROM ops WHERE clock % 2 = 0 AND identity NOT IN (SELECT identity FROM ops WHERE clock % 2 = 1)")
def new_identities(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    return sections.full_apply(ops.filter("clock % 2 = 0"), ops.filter("clock % 2 = 1"))


@query(f"""WITH {_STATE} SELECT count(*) AS entries, CAST(coalesce(sum(CAST(('0x' || substr(sha256(concat_ws('|', identity, section, key, clock, author, value, CASE WHEN deleted THEN 'true' ELSE 'false' END)), 1, 12)) AS HUGEINT)), 0) AS VARCHAR) AS digest FROM state""")
def document_hash(spark, sf_dir):
    return sections.document_hash(state.merge(P.ops(spark, sf_dir)))


@query(f"""WITH {_OPS}, cur AS (SELECT identity, key, max(value) AS hash FROM ops WHERE clock % 3 <> 0 GROUP BY 1, 2), prev AS (SELECT identity, key, max(value) AS hash FROM ops WHERE clock % 3 <> 1 GROUP BY 1, 2)
  SELECT identity, key, CASE WHEN prev.hash IS NULL THEN 'added' WHEN cur.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM cur FULL JOIN prev USING (identity, key) WHERE cur.hash IS DISTINCT FROM prev.hash""")
def local_changes(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    side = lambda c: ops.filter(c).groupBy("identity", "key").agg(F.max("value").alias("hash"))
    return sections.local_changes(side("clock % 3 <> 0"), side("clock % 3 <> 1"), ["identity", "key"])


@query(f"WITH {_OPS}, seen AS (SELECT identity, max(clock) AS clock FROM ops WHERE clock % 4 <> 0 GROUP BY 1) SELECT identity FROM (SELECT identity, max(clock) AS now FROM ops GROUP BY 1) LEFT JOIN seen USING (identity) WHERE clock IS NULL OR now > clock")
def safety_poll(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    return oplog.safety_poll(ops, ops.filter("clock % 4 <> 0").groupBy("identity").agg(F.max("clock").alias("clock")))


@query("SELECT event_id AS seq, 'room' || (user_id % 20) AS room, event_type AS kind FROM events")
def activity_feed(spark, sf_dir):
    d = P.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("room"), F.col("user_id") % 20).alias("room"), F.col("event_type").alias("kind"))
    return oplog.activity(d.filter("seq % 3 <> 0"), d.filter("seq % 3 <> 1"))


@query(f"WITH {_STATE} SELECT * FROM state")
def snapshot_pull(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    return state.merge(sections.snapshot_ops(state.merge(ops.filter("clock % 2 = 0")), ops.filter("clock % 2 = 1")))


# --- whole items, vaults, connections, warnings --------------------------------------------------


def _tree(spark, sf_dir, metadata=None):
    orders = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_id"), F.col("o_orderpriority").alias("title"))
    tags = P.ops(spark, sf_dir).filter("section = 'tags' and not deleted").select(F.substring("identity", 5, 20).cast("long").alias("local_id"), F.col("key").alias("name"))
    docs = P.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n_"), "doc_id").alias("uuid"), F.col("lang").alias("text"))
    notes = docs.select(F.concat(F.lit("cs"), F.col("doc_id") % 300).alias("parent"), "uuid", "text").union(docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("s_"), "doc_id"), F.concat(F.lit("m_"), "doc_id"), "text"))
    selections = docs.select(F.concat(F.lit("cs"), F.col("doc_id") % 200).alias("checksum"), F.concat(F.lit("s_"), "doc_id").alias("uuid"))
    tx = P.transcriptions(spark, sf_dir).select(F.concat(F.lit("cs"), F.col("conv_id") % 250).alias("checksum"), "uuid", "text")
    return items.tree(orders, P.photos(spark, sf_dir), tags, notes, selections, tx, metadata)


def flat_photo():
    """notes, selections and n_tx of a photo of a tree as text and numbers."""
    notes = F.array_join(F.transform("note", lambda n: F.concat(n["uuid"], n["text"])), ",")
    marks = F.transform("selection", lambda s: F.concat(s["uuid"], F.lit(":"), F.array_join(F.transform(s["note"], lambda n: n["uuid"]), ";")))
    return notes.alias("notes"), F.array_join(marks, ",").alias("selections"), F.size("transcription").cast("long").alias("n_tx")


@query(f"""WITH {_OPS}, {_PHOTOS}, tg AS (SELECT CAST(substr(identity, 5) AS BIGINT) AS local_id, string_agg(DISTINCT key, ',' ORDER BY key) AS tags FROM ops WHERE section = 'tags' AND NOT deleted GROUP BY 1),
  nt AS (SELECT 'cs' || (doc_id % 300) AS checksum, string_agg('n_' || doc_id || lang, ',' ORDER BY 'n_' || doc_id) AS notes FROM documents GROUP BY 1),
  sl AS (SELECT 'cs' || (doc_id % 200) AS checksum, string_agg('s_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ':m_' || doc_id ELSE ':' END, ',' ORDER BY 's_' || doc_id) AS selections FROM documents GROUP BY 1),
  tr AS (SELECT 'cs' || (conv_id % 250) AS checksum, count(*) AS n_tx FROM conversations GROUP BY 1)
  SELECT o_orderkey AS local_id, o_orderpriority AS title, coalesce(tags, '') AS tags, ordinal, checksum, coalesce(notes, '') AS notes, coalesce(selections, '') AS selections, coalesce(n_tx, 0) AS n_tx
  FROM orders LEFT JOIN tg ON o_orderkey = tg.local_id JOIN photos ON o_orderkey = photos.local_id LEFT JOIN nt USING (checksum) LEFT JOIN sl USING (checksum) LEFT JOIN tr USING (checksum)""")
def item_tree(spark, sf_dir):
    d = _tree(spark, sf_dir).select("local_id", "title", F.array_join("tag", ",").alias("tags"), F.inline("photo"))
    return d.select("local_id", "title", "tags", "ordinal", "checksum", *flat_photo())


@query(f"""WITH {_OPS} SELECT author, count(DISTINCT key) FILTER (WHERE section = 'notes') AS applied, count(DISTINCT key) FILTER (WHERE section = 'notes' AND deleted) * 3 AS failures, max(clock) AS push_seq, count(DISTINCT key) FILTER (WHERE section = 'lists') AS mapped FROM ops GROUP BY 1""")
def vault_load(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    keys = lambda c: F.array_sort(F.collect_set(F.when(F.expr(c), F.col("key"))))
    d = ops.groupBy("author").agg(keys("section = 'notes'").alias("a"), keys("section = 'notes' and deleted").alias("f"), F.max("clock").alias("pushSeq"), keys("section = 'lists'").alias("l"))
    text = F.to_json(F.struct((F.substring("author", 2, 1).cast("int") % 4 + 1).alias("version"), "pushSeq", F.col("a").alias("appliedNoteKeys"), F.col("f").alias("failedNoteKeys"), F.transform("l", lambda k: F.array(k, F.concat(F.lit("id"), k))).alias("listMappings")))
    first = d.select("author", readers.parse_vault(text).alias("v")).select("author", "v.*")
    again = first.select("author", F.struct(*[c for c in first.columns if c != "author"]).alias("v"))
    stored = readers.vault_text(first.withColumn("failedNoteKeys", F.col("failedNoteKeys"))).select(readers.parse_vault(F.col("value")).alias("v"))
    d = again.select("author", "v.pushSeq", "v.appliedNoteKeys", "v.failedNoteKeys", "v.listMappings").join(stored.select("v.pushSeq", F.col("v.failedNoteKeys").alias("again")), "pushSeq")
    failures = F.aggregate("again", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    return d.select("author", F.size("appliedNoteKeys").cast("long").alias("applied"), failures.alias("failures"), F.col("pushSeq").alias("push_seq"), F.size("listMappings").cast("long").alias("mapped"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'ws' WHEN 1 THEN 'file' ELSE 'snapshot' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS room, CASE c_custkey % 3 WHEN 1 THEN '/h' || c_nationkey WHEN 2 THEN 'h' || c_nationkey END AS path,
  CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN 't&k ' || c_custkey END AS token FROM customer""")
def connection_parameters(spark, sf_dir):
    n = F.col("c_custkey")
    kind = F.when(n % 3 == 0, "ws").when(n % 3 == 1, "file").otherwise("snapshot")
    s = readers.connection_string(kind, F.concat(F.lit("h"), "c_nationkey"), F.col("c_name"), F.when(n % 2 == 0, F.concat(F.lit("t&k "), n)))
    s = F.when(n % 5 == 0, F.concat(F.upper(F.substring(s, 1, 10)), F.substring(s, 11, 1000))).otherwise(s)
    return P.read(spark, sf_dir, "customer").select(n.alias("id"), readers.connection(s).alias("c")).select("id", "c.kind", "c.room", "c.path", "c.token")


@query(f"""WITH {_OPS}, e AS (SELECT identity, section, key, max(strlen(value) * clock) AS size, bool_or(deleted) AS deleted FROM ops WHERE section IN ('notes', 'transcriptions') GROUP BY 1, 2, 3)
  SELECT identity, coalesce(string_agg(w, '; ' ORDER BY w), '') AS warnings, count(w) = 0 AS valid FROM (SELECT identity, CASE WHEN NOT deleted AND size > CASE section WHEN 'notes' THEN 20000 ELSE 30000 END
  THEN CASE section WHEN 'notes' THEN 'Note ' ELSE 'Transcription ' END || key || ' exceeds max size (' || size || ' > ' || CASE section WHEN 'notes' THEN 20000 ELSE 30000 END || ')' END AS w FROM e) GROUP BY 1""")
def validate_warnings(spark, sf_dir):
    ops = P.ops(spark, sf_dir).filter("section in ('notes', 'transcriptions')")
    entries = ops.groupBy("identity", "section", "key").agg(F.max(F.octet_length("value") * F.col("clock")).alias("size"), F.bool_or("deleted").alias("deleted"))
    d = report.warnings(entries, {"notes": 20_000, "transcriptions": 30_000})
    return d.withColumn("warnings", F.array_join("warnings", "; "))


@query(f"""WITH {_STATE}, u AS (SELECT author, arg_max(value, clock) AS display_name FROM ops WHERE author <> 'u3' GROUP BY 1), c AS (SELECT DISTINCT identity, author FROM state WHERE NOT deleted AND author <> 'u0' AND section IN ({", ".join(f"'{s}'" for s in report.CREDITED)}))
  SELECT identity, author, coalesce(display_name, author) AS name, '@' || coalesce(display_name, author) AS tag, ['{"', '".join(scalar.PALETTE)}'][1 + abs(list_reduce(list_prepend(CAST(0 AS BIGINT), {_UNITS.format('author')}), lambda h, c: {_WRAP})) % 15] AS color FROM c LEFT JOIN u USING (author)""")
def contributor_credits(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    users = ops.filter("author <> 'u3'").groupBy("author").agg(F.max(F.struct("clock", "value"))["value"].alias("display_name"))
    return report.credits(state.merge(ops), users, ME)


@query(f"WITH {_STATE} SELECT identity, key, CAST(substr(identity, 5) AS BIGINT) % 3 <> 1 AS pushes, CAST(substr(identity, 5) AS BIGINT) % 3 = 0 AS applies FROM state WHERE section = 'tags'")
def mode_gate(spark, sf_dir):
    from palimpsest.config import SyncConfig

    modes = [SyncConfig.from_options({"mode": m}) for m in ("auto", "pull", "push")]
    gates = spark.createDataFrame([(m.mode, m.pushes, m.applies) for m in modes], "mode string, pushes boolean, applies boolean")
    mode = F.element_at(F.array(*map(F.lit, ("auto", "pull", "push"))), (F.col("number") % 3 + 1).cast("int"))
    d = state.merge(P.ops(spark, sf_dir)).filter("section = 'tags'").withColumn("number", F.substring("identity", 5, 20).cast("long"))
    return d.withColumn("mode", mode).join(F.broadcast(gates), "mode").select("identity", "key", "pushes", "applies")
