"""The queries of the engine over the driver's tables, each with its twin in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalar, text
from palimpsest.operators import hierarchy, items, maintain, match, reconcile, report, state, writes
from palimpsest.plans.registry import QUERIES, SQL, query
from palimpsest.session import written
from palimpsest.sources import projections as P

ME = "u0"
#: Tombstones before this time (ms) are old: the middle of the event table's span.
CUTOFF_SHARE = 2


# --- CTEs of the oracles -------------------------------------------------------------------------

_OPS = """ops AS (SELECT 'item' || user_id AS identity,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6 WHEN 0 THEN 'tags' WHEN 1 THEN 'notes' WHEN 2 THEN 'selections'
    WHEN 3 THEN 'selectionNotes' WHEN 4 THEN 'transcriptions' ELSE 'lists' END AS section,
  'k' || regexp_extract(props, '([0-9]+)', 1) AS key, 'u' || (event_id % 5) AS author, event_id AS clock, event_type AS value,
  event_type = 'error' AS deleted, epoch_us(ts) // 1000 AS "at" FROM events)"""
_STATE = _OPS + """, state AS (SELECT identity, section, key, clock, author, value, deleted, CASE WHEN deleted THEN "at" END AS deleted_at
  FROM ops QUALIFY row_number() OVER (PARTITION BY identity, section, key ORDER BY clock DESC, author DESC, value DESC) = 1)"""
_CUT = """, cut AS (SELECT (min("at") + max("at")) // 2 AS t FROM ops)"""
_PHOTOS = "photos AS (SELECT l_orderkey AS local_id, l_linenumber AS ordinal, 'cs' || l_partkey AS checksum FROM lineitem)"
_IDENT = "substr(sha256(array_to_string(list_sort(list(checksum)), ':')), 1, 32) AS identity"
_MATCH = (
    _PHOTOS
    + f""", local AS (SELECT local_id, {_IDENT} FROM photos GROUP BY local_id), ix AS (SELECT identity, max(local_id) AS local_id FROM local GROUP BY identity),
  rp AS (SELECT local_id AS remote_id, ordinal, checksum FROM photos WHERE local_id % 4 = 0 AND (local_id % 3 <> 1 OR ordinal <> 1)),
  r0 AS (SELECT remote_id, {_IDENT} FROM rp GROUP BY remote_id),
  remote AS (SELECT remote_id, CASE WHEN remote_id % 3 = 2 THEN 'old' || identity ELSE identity END AS identity FROM r0),
  aliases AS (SELECT 'old' || identity AS old_identity, min(remote_id) AS ordinal, identity AS target FROM r0 WHERE remote_id % 3 = 2 GROUP BY identity),
  exact AS (SELECT remote_id, local_id FROM remote JOIN ix USING (identity)),
  alias0 AS (SELECT remote_id, ix.local_id FROM remote JOIN aliases a ON remote.identity = a.old_identity JOIN ix ON ix.identity = a.target
    WHERE remote_id NOT IN (SELECT remote_id FROM exact) AND ix.local_id NOT IN (SELECT local_id FROM exact)),
  alias AS (SELECT min(remote_id) AS remote_id, local_id FROM alias0 GROUP BY local_id)"""
)
_FUZZY = """, rs AS (SELECT DISTINCT remote_id, checksum FROM rp), ls AS (SELECT DISTINCT local_id, checksum FROM photos),
  both_ AS (SELECT remote_id, local_id, count(*) AS n FROM rs JOIN ls USING (checksum) GROUP BY ALL),
  scored AS (SELECT remote_id, local_id, n / (a + b - n) AS score FROM both_ JOIN (SELECT remote_id, count(*) AS a FROM rs GROUP BY 1) USING (remote_id)
    JOIN (SELECT local_id, count(*) AS b FROM ls GROUP BY 1) USING (local_id)),
  fuzzy AS (SELECT remote_id, local_id, score FROM scored WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY remote_id ORDER BY score DESC, local_id) = 1)"""
_REC = """line AS (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS remote_text, max(l_returnflag) AS flag, max(l_suppkey % 3) AS a FROM lineitem GROUP BY 1, 2),
  ord AS (SELECT o_orderkey, max(o_orderstatus) AS local_text FROM orders GROUP BY 1),
  rec AS (SELECT 'item' || o_orderkey AS identity, 'dc:field' || l_linenumber AS key, local_text, remote_text,
    CASE WHEN l_linenumber % 2 = 0 THEN local_text ELSE flag END AS pushed_text, 'u' || a AS remote_author FROM ord JOIN line ON o_orderkey = l_orderkey)"""
_APPLY = "CASE WHEN remote_author = 'u0' THEN 'skip_own' WHEN local_text IS NULL THEN 'apply' WHEN local_text = remote_text THEN 'skip_equal' WHEN pushed_text IS NULL OR local_text <> pushed_text THEN 'conflict_local' ELSE 'apply' END"
_PUSH = "CASE WHEN coalesce(local_text, '') = '' AND remote_text IS NULL THEN 'skip_empty' WHEN local_text = remote_text THEN 'skip_equal' WHEN remote_text IS NOT NULL AND remote_author <> 'u0' AND local_text = pushed_text THEN 'conflict_remote' ELSE 'push' END"
_SEL = """sel AS (SELECT 's_' || l_orderkey || '_' || l_linenumber AS uuid, 'cs' || l_partkey AS photo, 'u' || (l_suppkey % 5) AS author, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS w, l_tax * 100 AS h FROM lineitem)"""
_NOTES = "notes AS (SELECT 'n_' || doc_id AS uuid, doc_id, text, 'u' || (doc_id % 5) AS author, 'cs' || (doc_id % 50) AS photo FROM documents)"
_LISTS = "nodes AS (SELECT 'r' || r_regionkey AS uuid, CAST(NULL AS VARCHAR) AS parent, r_name AS name, CAST(r_regionkey AS BIGINT) AS ordinal FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CAST(n_nationkey + 100 AS BIGINT) FROM nation)"
_UNITS = "list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))"


def _fnv(s: str, seed: int) -> str:
    x = "xor(h, c)"
    return f"list_reduce(list_prepend(CAST({seed} AS BIGINT), {_UNITS.format(s)}), lambda h, c: (CAST(CAST({x} - CASE WHEN {x} >= 2147483648 THEN 4294967296 ELSE 0 END AS DOUBLE) * 16777619.0 AS BIGINT) % 4294967296 + 4294967296) % 4294967296)"


def _fnv_hex(s: str) -> str:
    return " || ".join(f"lpad(lower(to_hex({_fnv(s, seed)})), 8, '0')" for seed in scalar.FNV_SEEDS)


def _escape_sql(s: str) -> str:
    for plain, escaped in text.ESCAPES:
        s = f"replace({s}, '{plain.replace(chr(39), chr(39) * 2)}', '{escaped}')"
    return s


def _normalize_sql(s: str) -> str:
    for tag, before, after in text.REWRITES:
        s = f"regexp_replace({s}, '<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', '{before}\\1{after}', 'gis')"
    return s


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merge(P.ops(spark, sf_dir))


# --- state ---------------------------------------------------------------------------------------


@query(f"WITH {_STATE} SELECT * FROM state")
def lww_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"WITH {_STATE} SELECT identity, section, key, author, value FROM state WHERE NOT deleted")
def active_entries(spark, sf_dir):
    return state.live(_state(spark, sf_dir)).select("identity", "section", "key", "author", "value")


@query(f"WITH {_STATE} SELECT identity, section, key, deleted_at FROM state WHERE deleted")
def tombstones(spark, sf_dir):
    return state.tombstones(_state(spark, sf_dir)).select("identity", "section", "key", "deleted_at")


@query(f"WITH {_STATE} SELECT identity, section, key, author FROM state WHERE author IS DISTINCT FROM 'u0' AND NOT deleted")
def foreign_entries(spark, sf_dir):
    return state.foreign(state.live(_state(spark, sf_dir)), ME).select("identity", "section", "key", "author")


@query(f"""WITH {_OPS}, t AS (SELECT *, lag(value) OVER w AS was, coalesce(lag(deleted) OVER w, true) AS gone FROM ops WHERE section = 'tags' WINDOW w AS (PARTITION BY identity, key ORDER BY clock))
  SELECT identity, section, key, clock, author, value, deleted FROM t WHERE (NOT deleted AND (gone OR value IS DISTINCT FROM was)) OR (deleted AND NOT gone)
  QUALIFY row_number() OVER (PARTITION BY identity, key ORDER BY clock DESC) = 1""")
def tag_state(spark, sf_dir):
    return state.merge(state.tag_writes(P.ops(spark, sf_dir))).drop("deleted_at")


@query(f"""WITH {_OPS}, o AS (SELECT * REPLACE (CASE WHEN clock % 3 = 0 THEN upper(key) ELSE key END AS key) FROM ops WHERE section = 'tags'),
  s AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY identity, key ORDER BY clock DESC) = 1)
  SELECT identity, section, lower(key) AS key, key AS old_key, author, value, deleted FROM s
  QUALIFY row_number() OVER (PARTITION BY identity, lower(key) ORDER BY deleted, key <> lower(key), clock) = 1""")
def tag_key_migrate(spark, sf_dir):
    mixed = P.ops(spark, sf_dir).filter("section = 'tags'").withColumn("key", F.when(F.col("clock") % 3 == 0, F.upper("key")).otherwise(F.col("key")))
    return state.lower_tag_keys(state.merge(mixed))


@query(f"WITH {_OPS} SELECT identity, section, key, arg_min(author, clock) AS author FROM ops GROUP BY ALL")
def original_author(spark, sf_dir):
    return state.first_author(P.ops(spark, sf_dir))


@query(f"WITH {_STATE} SELECT identity, section, count(*) AS n, string_agg(key || '=' || value, ',' ORDER BY key) AS entries FROM state WHERE NOT deleted GROUP BY 1, 2")
def item_snapshot(spark, sf_dir):
    d = state.snapshot(_state(spark, sf_dir))
    shown = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.select("identity", "section", F.size("entries").cast("long").alias("n"), F.array_join(shown, ",").alias("entries"))


@query(f"WITH {_OPS} SELECT DISTINCT identity FROM ops")
def identities(spark, sf_dir):
    return P.ops(spark, sf_dir).select("identity").distinct()


@query(f"WITH {_STATE} SELECT identity, section, key FROM state WHERE section = 'selections' AND starts_with(key, 'k1')")
def prefix_scan(spark, sf_dir):
    return _state(spark, sf_dir).filter("section = 'selections'").filter(F.col("key").startswith("k1")).select("identity", "section", "key")


# --- maintenance ---------------------------------------------------------------------------------


def _cutoff(ops: DataFrame) -> int:
    r = ops.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    return (r["a"] + r["b"]) // 2


@query(f"WITH {_STATE}{_CUT} SELECT identity, section, key, deleted_at FROM state, cut WHERE deleted AND (deleted_at IS NULL OR deleted_at < t)")
def purge_plan(spark, sf_dir):
    return maintain.purge_plan(_state(spark, sf_dir), _cutoff(P.ops(spark, sf_dir))).select("identity", "section", "key", "deleted_at")


@query(f"WITH {_STATE}{_CUT} SELECT identity, section, key, deleted_at FROM state, cut WHERE deleted AND deleted_at < t")
def purge_plan_server(spark, sf_dir):
    return maintain.purge_plan(_state(spark, sf_dir), _cutoff(P.ops(spark, sf_dir)), server=True).select("identity", "section", "key", "deleted_at")


@query(f"WITH {_STATE} SELECT count(DISTINCT identity) AS items, count(*) FILTER (deleted) AS purged FROM state")
def purge_stats(spark, sf_dir):
    s = _state(spark, sf_dir)
    return maintain.purge_stats(s, maintain.purge_plan(s, None))


@query(f"WITH {_STATE} SELECT DISTINCT identity, key FROM ops WHERE (identity, key) NOT IN (SELECT identity, key FROM state WHERE NOT deleted)")
def orphan_uuids(spark, sf_dir):
    s = _state(spark, sf_dir)
    registry = P.ops(spark, sf_dir).select("identity", "key").distinct()
    return maintain.orphans(registry, s, maintain.purge_plan(s, None))


@query(f"""WITH {_STATE}{_CUT} SELECT identity, section, key, author, clock, value, deleted, deleted_at AS "at" FROM state, cut WHERE NOT (deleted AND deleted_at < t)""")
def compact(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    return maintain.compact(ops, _cutoff(ops))


@query(f"""WITH {_OPS}{_CUT}, win AS (SELECT identity, section, key, value, deleted FROM ops QUALIFY row_number() OVER (PARTITION BY identity, section, key ORDER BY clock DESC) = 1),
  old AS (SELECT identity, section, key, value, deleted FROM ops, cut WHERE "at" < t QUALIFY row_number() OVER (PARTITION BY identity, section, key ORDER BY clock DESC) = 1)
  SELECT old.identity, old.section, old.key, 'u0' AS author, CAST(1000000000 AS BIGINT) AS clock, old.value, old.deleted FROM old JOIN win USING (identity, section, key)
  WHERE old.value <> win.value OR old.deleted <> win.deleted""")
def rollback(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    version = state.merge(ops.filter(F.col("at") < _cutoff(ops))).select(*state.KEY, "value", "deleted")
    return maintain.rollback(version, state.merge(ops), ME, 1_000_000_000).drop("at")


# --- linkage -------------------------------------------------------------------------------------


@query(f"WITH {_PHOTOS} SELECT local_id, string_agg(checksum, ',' ORDER BY checksum) AS checksums, count(*) AS n FROM photos GROUP BY 1")
def item_checksums(spark, sf_dir):
    return P.photos(spark, sf_dir).groupBy("local_id").agg(F.array_join(F.array_sort(F.collect_list("checksum")), ",").alias("checksums"), F.count("*").alias("n"))


@query(f"WITH {_PHOTOS} SELECT local_id, {_IDENT} FROM photos GROUP BY local_id")
def item_identity(spark, sf_dir):
    return match.identities(P.photos(spark, sf_dir), "local_id")


@query(f"WITH {_PHOTOS}, i AS (SELECT local_id, {_IDENT} FROM photos GROUP BY local_id) SELECT identity, max(local_id) AS local_id FROM i GROUP BY identity")
def dedup_items(spark, sf_dir):
    return match.index(match.identities(P.photos(spark, sf_dir), "local_id"))


@query("SELECT o_orderkey AS local_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def syncable_items(spark, sf_dir):
    known = P.photos(spark, sf_dir).filter("checksum <> ''").select("local_id").distinct()
    return P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_id")).join(known, "local_id", "left_semi")


def _matching(spark, sf_dir, keep=lambda d, _: d):
    """``keep`` may write what several parts of a plan read. Of our identities only those that are asked for are kept."""
    local_photos, remote_photos = P.photos(spark, sf_dir), P.remote_photos(spark, sf_dir)
    now = keep(match.identities(remote_photos, "remote_id"), "remote")
    old = F.col("remote_id") % 3 == 2
    remote = now.withColumn("identity", F.when(old, F.concat(F.lit("old"), "identity")).otherwise(F.col("identity")))
    aliases = now.filter(old).groupBy("identity").agg(F.min("remote_id").alias("ordinal")).select(F.concat(F.lit("old"), "identity").alias("old_identity"), "ordinal", F.col("identity").alias("target"))
    asked = remote.select("identity").unionByName(aliases.select(F.col("target").alias("identity")))
    local = keep(match.index(match.identities(local_photos, "local_id")).join(asked, "identity", "left_semi"), "local")
    exact = keep(match.exact(remote, local), "exact")
    return exact, keep(match.alias(remote, local, exact, aliases), "alias"), local_photos, remote_photos


@query(f"WITH {_MATCH} SELECT remote_id, local_id FROM exact")
def match_exact(spark, sf_dir):
    return _matching(spark, sf_dir)[0]


@query(f"WITH {_MATCH} SELECT remote_id, local_id FROM alias")
def match_alias(spark, sf_dir):
    return _matching(spark, sf_dir)[1]


@query(f"WITH {_MATCH}{_FUZZY} SELECT remote_id, local_id, score FROM fuzzy")
def match_fuzzy(spark, sf_dir):
    _, _, local_photos, remote_photos = _matching(spark, sf_dir)
    return match.similar(remote_photos, local_photos)


@query(f"""WITH {_MATCH}{_FUZZY}, e1 AS (SELECT min(remote_id) AS remote_id, local_id, 'exact' AS kind FROM exact GROUP BY local_id),
  taken AS (SELECT * FROM e1 UNION ALL SELECT remote_id, local_id, 'alias' FROM alias),
  f1 AS (SELECT min(remote_id) AS remote_id, local_id, 'fuzzy' AS kind FROM fuzzy WHERE remote_id NOT IN (SELECT remote_id FROM taken) AND local_id NOT IN (SELECT local_id FROM taken) GROUP BY local_id)
  SELECT * FROM taken UNION ALL SELECT * FROM f1""")
def match_resolved(spark, sf_dir):
    """Only remote items that neither content nor an alias matched are compared by similarity: no other could be claimed so."""
    exact, alias, local_photos, remote_photos = _matching(spark, sf_dir, written)
    taken = written(match.taken(exact, alias), "taken")
    rest = remote_photos.join(taken, "remote_id", "left_anti")
    return match.resolve(taken, written(match.similar(rest, local_photos), "similar"))


# --- items ---------------------------------------------------------------------------------------


def _enriched(spark, sf_dir):
    metadata = P.read(spark, sf_dir, "part").select(F.concat(F.lit("cs"), "p_partkey").alias("checksum"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    orders = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_id"), F.col("o_orderpriority").alias("title"))
    return items.enrich(orders, P.photos(spark, sf_dir), metadata)


@query()
def item_enriched(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query(f"""WITH {_PHOTOS} SELECT o_orderkey AS local_id, o_orderpriority AS title, ordinal, checksum, p_brand AS brand, p_size AS size
  FROM orders JOIN photos ON o_orderkey = local_id LEFT JOIN part ON checksum = 'cs' || p_partkey""")
def item_enriched_flat(spark, sf_dir):
    return _enriched(spark, sf_dir).select("local_id", "title", F.inline("photo"))


def _customer_map(spark, sf_dir):
    entries = F.create_map(F.lit("@id"), F.col("c_custkey").cast("string"), F.lit("_rev"), F.lit("1"), F.lit("photo"), F.lit("x"), F.lit("dc:title"), F.col("c_name"), F.lit("http://purl.org/dc/terms/type"), F.col("c_mktsegment"), F.lit("plain"), F.lit("y"))
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("local_id"), entries.alias("m"))


_CUSTOMER = "kv AS (SELECT c_custkey AS local_id, unnest(['@id', '_rev', 'photo', 'dc:title', 'http://purl.org/dc/terms/type', 'plain']) AS key, unnest([CAST(c_custkey AS VARCHAR), '1', 'x', c_name, c_mktsegment, 'y']) AS value FROM customer)"


@query(f"WITH {_CUSTOMER} SELECT local_id, key, value FROM kv WHERE key LIKE '%:%' OR key LIKE '%/%'")
def metadata_props(spark, sf_dir):
    return _customer_map(spark, sf_dir).select("local_id", F.explode("m").alias("key", "value")).filter(items.is_property(F.col("key")))


@query(f"WITH {_CUSTOMER} SELECT local_id, count(*) AS n, string_agg(key, ',' ORDER BY key) AS keys FROM kv WHERE key NOT IN ('@id', '_rev', 'photo') GROUP BY 1")
def backup_metadata(spark, sf_dir):
    d = _customer_map(spark, sf_dir).select("local_id", items.strip_structure(F.col("m")).alias("m"))
    return d.select("local_id", F.size("m").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


@query(f"""WITH {_CUSTOMER} SELECT local_id, CASE WHEN key = 'dc:title' THEN 'http://purl.org/dc/elements/1.1/title' WHEN key IN ('_rev', 'plain') THEN 'http://example.org/vocab/' || key ELSE key END AS uri, value FROM kv""")
def jsonld_expand(spark, sf_dir):
    context = spark.createDataFrame([("dc", "http://purl.org/dc/elements/1.1/")], "prefix string, base string")
    kv = _customer_map(spark, sf_dir).select("local_id", F.explode("m").alias("key", "value")).withColumn("prefix", F.split("key", ":")[0])
    kv = kv.join(F.broadcast(context), "prefix", "left")
    return kv.select("local_id", items.expand_key(F.col("key"), F.col("base"), "http://example.org/vocab/").alias("uri"), "value")


@query("""SELECT c_custkey AS local_id, c_name AS text, CASE WHEN c_custkey % 3 = 1 THEN 'http://www.w3.org/2001/XMLSchema#date' ELSE 'http://www.w3.org/2001/XMLSchema#string' END AS type,
  CASE WHEN c_custkey % 3 = 2 THEN 'en' END AS language FROM customer""")
def literal_extract(spark, sf_dir):
    json = lambda **k: F.to_json(F.struct(*[F.when(F.lit(True), v).alias(n) for n, v in k.items()]))
    name = F.col("c_name")
    value = F.when(F.col("c_custkey") % 3 == 0, name).when(F.col("c_custkey") % 3 == 1, json(**{"@value": name, "@type": F.lit("http://www.w3.org/2001/XMLSchema#date")})).otherwise(json(text=name, language=F.lit("en")))
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("local_id"), items.literal(value).alias("v")).select("local_id", "v.*")


@query("SELECT p_partkey AS local_id, 'https://example.org/' || p_brand AS uri FROM part WHERE NOT starts_with(p_brand, 'Brand#1')")
def custom_templates(spark, sf_dir):
    d = P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("local_id"), F.concat(F.lit("https://example.org/"), "p_brand").alias("uri"))
    return d.filter(~items.is_preset(F.col("uri"), ("https://example.org/Brand#1",)))


# --- reconciliation ------------------------------------------------------------------------------


def _plan(spark, sf_dir, decide, rows=None):
    d = P.reconcile_input(spark, sf_dir) if rows is None else rows
    pushed = F.when(F.col("pushed_text").isNotNull(), reconcile.field_hash(F.col("pushed_text")))
    return d.withColumn("action", decide(F.col("local_text"), F.col("remote_text"), F.col("remote_author"), pushed, ME))


@query(f"WITH {_REC} SELECT identity, key, {_PUSH} AS action FROM rec")
def push_plan_metadata(spark, sf_dir, rows=None):
    return _plan(spark, sf_dir, reconcile.push_action, rows).select("identity", "key", "action")


@query(f"WITH {_REC} SELECT identity, key, {_APPLY} AS action FROM rec")
def apply_plan_metadata(spark, sf_dir, rows=None):
    return _plan(spark, sf_dir, reconcile.apply_action, rows).select("identity", "key", "action")


@query(f"""WITH {_REC}, p AS (SELECT *, {_APPLY} AS action FROM rec) SELECT substr(identity, 1, 8) AS identity, key, local_text AS local, remote_text AS remote, remote_author AS author, 'local-wins' AS resolution FROM p WHERE action = 'conflict_local'""")
def conflicts(spark, sf_dir):
    return reconcile.conflicts(_plan(spark, sf_dir, reconcile.apply_action))


@query(f"WITH {_REC}, p AS (SELECT {_APPLY} AS action FROM rec) SELECT action, count(*) AS n FROM p GROUP BY 1")
def apply_stats(spark, sf_dir):
    return _plan(spark, sf_dir, reconcile.apply_action).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_REC} SELECT identity, key, substr(sha256(coalesce(pushed_text, '') || '|http://www.w3.org/2001/XMLSchema#string'), 1, 16) AS hash FROM rec")
def field_hashes(spark, sf_dir):
    return P.reconcile_input(spark, sf_dir).select("identity", "key", reconcile.field_hash(F.col("pushed_text")).alias("hash"))


@query(f"WITH {_REC} SELECT identity, key, NOT (coalesce(remote_text, '') = '' AND coalesce(local_text, '') <> '') AS allowed FROM rec")
def should_overwrite(spark, sf_dir):
    return P.reconcile_input(spark, sf_dir).select("identity", "key", reconcile.may_overwrite(F.col("local_text"), F.col("remote_text")).alias("allowed"))


_MINE = ", mine AS (SELECT DISTINCT identity, lower(key) AS key FROM ops WHERE section = 'tags' AND author = 'u1'), st AS (SELECT * FROM state WHERE section = 'tags')"


@query(f"""WITH {_STATE}{_MINE} SELECT mine.identity, mine.key, CASE WHEN st.key IS NULL THEN 'push' WHEN NOT st.deleted THEN 'skip_equal' WHEN st.author = 'u0' THEN 'push' ELSE 'blocked' END AS action
  FROM mine LEFT JOIN st ON mine.identity = st.identity AND mine.key = lower(st.key)""")
def push_plan_tags(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    mine = ops.filter("section = 'tags' and author = 'u1'").select("identity", F.lower("key").alias("key")).distinct()
    st = state.merge(ops.filter("section = 'tags'")).select("identity", F.lower("key").alias("key"), "deleted", "author", F.lit(True).alias("there"))
    d = mine.join(st, ["identity", "key"], "left")
    return d.select("identity", "key", reconcile.tag_push_action(F.coalesce("there", F.lit(False)), F.col("deleted"), F.col("author"), ME).alias("action"))


_LOCAL_TAGS = ", have AS (SELECT DISTINCT identity, lower(key) AS key FROM ops WHERE section = 'tags' AND author = 'u2' AND NOT deleted)"


@query(f"""WITH {_STATE}{_LOCAL_TAGS}, f AS (SELECT identity, lower(key) AS key, deleted FROM state WHERE section = 'tags' AND author IS DISTINCT FROM 'u0')
  SELECT f.identity, f.key, CASE WHEN f.deleted THEN 'remove' ELSE 'add' END AS action FROM f LEFT JOIN have USING (identity, key) WHERE (NOT f.deleted AND have.key IS NULL) OR (f.deleted AND have.key IS NOT NULL)""")
def apply_tags(spark, sf_dir):
    ops = P.ops(spark, sf_dir).filter("section = 'tags'")
    have = ops.filter("author = 'u2' and not deleted").select("identity", F.lower("key").alias("key")).distinct()
    theirs = state.foreign(state.merge(ops), ME).select("identity", F.lower("key").alias("key"), "deleted")
    add = theirs.filter("not deleted").join(have, ["identity", "key"], "left_anti").withColumn("action", F.lit("add"))
    gone = theirs.filter("deleted").join(have, ["identity", "key"], "left_semi").withColumn("action", F.lit("remove"))
    return add.unionByName(gone).drop("deleted")


@query(f"""WITH {_NOTES}, here AS (SELECT DISTINCT trim(text) AS text FROM notes WHERE doc_id % 2 = 0 AND text <> '')
  SELECT uuid, CASE WHEN author = 'u0' THEN 'skip_own' WHEN coalesce(text, '') = '' THEN 'skip_empty' WHEN doc_id % 50 >= 40 THEN 'no_parent' WHEN trim(text) IN (SELECT text FROM here) THEN 'dedup' ELSE 'create' END AS action FROM notes WHERE doc_id % 2 = 1""")
def apply_notes(spark, sf_dir):
    n = P.notes(spark, sf_dir)
    here = n.filter("doc_id % 2 = 0 and text <> ''").select(text.without_text_marks(F.col("text")).alias("plain")).distinct().withColumn("there", F.lit(True))
    parents = spark.range(40).select(F.concat(F.lit("cs"), "id").alias("photo"), F.lit(True).alias("parent"))
    d = n.filter("doc_id % 2 = 1").withColumn("plain", F.trim("text")).join(here, "plain", "left").join(F.broadcast(parents), "photo", "left")
    action = F.when(F.col("author") == ME, "skip_own").when(F.coalesce("text", F.lit("")) == "", "skip_empty").when(F.col("parent").isNull(), "no_parent").when(F.col("there").isNotNull(), "dedup").otherwise("create")
    return d.select("uuid", action.alias("action"))


@query(f"""WITH {_NOTES}, here AS (SELECT DISTINCT trim(text) AS t FROM notes WHERE doc_id % 2 = 0 AND text <> '') SELECT uuid FROM notes WHERE doc_id % 2 = 1 AND trim(text) NOT IN (SELECT t FROM here)""")
def note_dedup(spark, sf_dir):
    n = P.notes(spark, sf_dir)
    marked = F.concat(F.col("text"), F.lit(f"\n[{text.MARK}:n_1 from someone]"))
    here = n.filter("doc_id % 2 = 0 and text <> ''").select(text.without_text_marks(marked).alias("plain")).distinct()
    return n.filter("doc_id % 2 = 1").withColumn("plain", F.trim("text")).join(here, "plain", "left_anti").select("uuid")


@query(f"WITH {_NOTES} SELECT uuid AS note_key, doc_id AS local_id FROM notes")
def note_locate(spark, sf_dir):
    n = P.notes(spark, sf_dir)
    local = n.select(F.col("doc_id").alias("local_id"), F.concat(F.lit("<p>x</p>"), text.footer(F.col("uuid"), F.col("author"))).alias("html"))
    local = local.select("local_id", text.footer_key(F.col("html")).alias("note_key"))
    return n.select(F.col("uuid").alias("note_key")).join(local, "note_key")


@query(f"WITH {_NOTES} SELECT uuid, CASE WHEN doc_id % 50 < 40 THEN photo ELSE 'cs0' END AS parent FROM notes")
def note_parent(spark, sf_dir):
    parents = spark.range(40).select(F.concat(F.lit("cs"), "id").alias("photo"), F.concat(F.lit("cs"), "id").alias("found"))
    return P.notes(spark, sf_dir).join(F.broadcast(parents), "photo", "left").select("uuid", F.coalesce("found", F.lit("cs0")).alias("parent"))


@query(f"""WITH {_OPS}, s AS (SELECT identity, section, key, arg_max(deleted, clock) AS deleted, arg_max(author, clock) AS author, arg_min(author, clock) AS original FROM ops WHERE section IN ('notes', 'selectionNotes') GROUP BY ALL)
  SELECT identity, section, key, author, original, author = original AS accepted FROM s WHERE deleted""")
def ownership_guard(spark, sf_dir):
    ops = P.ops(spark, sf_dir).filter("section in ('notes', 'selectionNotes')")
    first = state.first_author(ops).withColumnRenamed("author", "original")
    d = state.tombstones(state.merge(ops)).join(first, state.KEY)
    return d.select(*state.KEY, "author", "original", reconcile.accepts_tombstone(F.col("original"), F.col("author")).alias("accepted"))


@query(f"""WITH {_OPS}, s AS (SELECT identity, key, arg_max(deleted, clock) AS deleted, arg_max(author, clock) AS author, arg_min(author, clock) AS original, max(clock) AS seq FROM ops WHERE section = 'notes' GROUP BY ALL)
  SELECT identity, key, '<p><span style="text-decoration: line-through">' || key || '</span></p><p><sub>[overlay:' || key || ' from ' || author || ' — safe to delete, do not edit]</sub></p>' AS html FROM s WHERE deleted AND author <> 'u0' AND author = original AND seq % 7 <> 0""")
def retract_notes(spark, sf_dir):
    ops = P.ops(spark, sf_dir).filter("section = 'notes'")
    first = state.first_author(ops).withColumnRenamed("author", "original")
    d = state.foreign(state.tombstones(state.merge(ops)), ME).join(first, state.KEY).filter(reconcile.accepts_tombstone(F.col("original"), F.col("author")))
    d = d.withColumn("dismissed", F.when(F.col("clock") % 7 == 0, F.col("clock"))).filter(~reconcile.is_dismissed(F.col("clock"), F.col("dismissed")))
    body = text.strike_through(F.concat(F.lit("<p>"), "key", F.lit("</p>")))
    return d.select("identity", "key", F.concat(body, text.footer(F.col("key"), F.col("author"))).alias("html"))


@query(f"WITH {_STATE} SELECT identity, section, key, clock <= CASE WHEN clock % 5 = 0 THEN clock + 1 WHEN clock % 5 = 1 THEN clock - 1 END IS TRUE AS dismissed FROM state WHERE section = 'notes'")
def dismissed(spark, sf_dir):
    mark = F.when(F.col("clock") % 5 == 0, F.col("clock") + 1).when(F.col("clock") % 5 == 1, F.col("clock") - 1)
    return _state(spark, sf_dir).filter("section = 'notes'").select(*state.KEY, reconcile.is_dismissed(F.col("clock"), mark).alias("dismissed"))


@query(f"WITH {_STATE} SELECT identity, key, (clock % 5 = 0) OR clock % 11 >= 3 AS skipped FROM state WHERE section = 'notes'")
def skip_notes(spark, sf_dir):
    mark = F.when(F.col("clock") % 5 == 0, F.col("clock"))
    return _state(spark, sf_dir).filter("section = 'notes'").select("identity", "key", reconcile.skips_note(F.col("clock"), mark, F.col("clock") % 11).alias("skipped"))


@query(f"""WITH {_OPS}, prev AS (SELECT DISTINCT identity, section, key FROM ops WHERE clock % 3 <> 0), cur AS (SELECT DISTINCT identity, section, key FROM ops WHERE clock % 3 <> 1)
  SELECT * FROM prev WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.identity = prev.identity AND cur.section = prev.section AND CASE WHEN prev.section = 'tags' THEN lower(cur.key) = lower(prev.key) ELSE cur.key = prev.key END)""")
def deletions(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    keys = lambda c: ops.filter(c).select(*state.KEY).distinct()
    return reconcile.deletions(keys("clock % 3 <> 0"), keys("clock % 3 <> 1"))


@query(f"""WITH {_STATE}, pushed AS (SELECT DISTINCT identity, section, key FROM ops WHERE clock % 4 = 0), prev AS (SELECT DISTINCT identity, section, key FROM ops WHERE clock % 4 = 1)
  SELECT identity, section, key FROM state WHERE author = 'u0' AND NOT deleted AND section IN ('notes', 'selectionNotes') AND (identity, section, key) NOT IN (FROM pushed) AND (identity, section, key) NOT IN (FROM prev)""")
def stale_notes(spark, sf_dir):
    ops = P.ops(spark, sf_dir)
    keys = lambda c: ops.filter(c).select(*state.KEY).distinct()
    mine = state.live(state.merge(ops)).filter((F.col("author") == ME) & F.col("section").isin("notes", "selectionNotes")).select(*state.KEY)
    return reconcile.stale(mine, keys("clock % 4 = 0"), keys("clock % 4 = 1"))


@query(f"WITH {_OPS} SELECT DISTINCT identity, section, CASE WHEN section = 'tags' THEN lower(key) ELSE key END AS key FROM ops WHERE NOT deleted")
def item_keys(spark, sf_dir):
    key = F.when(F.col("section") == "tags", F.lower("key")).otherwise(F.col("key"))
    return P.ops(spark, sf_dir).filter("not deleted").select("identity", "section", key.alias("key")).distinct()


@query(f"""WITH {_PHOTOS}, c AS (SELECT local_id, substr(sha256(string_agg(checksum, ':' ORDER BY checksum)), 1, 16) AS hash FROM photos GROUP BY 1)
  SELECT 'item' || local_id AS identity, hash FROM c WHERE local_id % 5 IN (0, 1)""")
def changed_items(spark, sf_dir):
    d = P.photos(spark, sf_dir).groupBy("local_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("checksum")), ":"), 256), 1, 16).alias("hash"))
    now = d.select(F.concat(F.lit("item"), "local_id").alias("identity"), "hash", "local_id")
    last = now.filter("local_id % 5 <> 0").select("identity", F.when(F.col("local_id") % 5 == 1, F.lit("stale")).otherwise(F.col("hash")).alias("hash"))
    return reconcile.changed(now, last).select("identity", "hash")


@query(f"""WITH {_STATE}, e AS (SELECT identity, section, '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}}' AS entries FROM state WHERE NOT deleted GROUP BY 1, 2)
  SELECT *, substr(sha256('{{"entries":"' || replace(entries, '"', '\\"') || '","identity":"' || identity || '","section":"' || section || '"}}'), 1, 16) AS hash FROM e""")
def backup_snapshot(spark, sf_dir):
    d = state.snapshot(_state(spark, sf_dir))
    return d.select("identity", "section", F.to_json("entries").alias("entries"), scalar.content_hash("identity", "section", entries=F.to_json("entries")).alias("hash"))


@query("SELECT 's_' || l_orderkey || '_' || l_linenumber AS uuid, l_partkey FROM lineitem WHERE isfinite(l_quantity) AND l_discount * 100 > 0 AND l_tax * 100 > 0")
def valid_rects(spark, sf_dir):
    d = P.selections(spark, sf_dir).filter(scalar.valid_rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return d.select("uuid", F.substring("photo", 3, 20).cast("long").alias("l_partkey"))


_RECT = "photo || ':' || CAST(floor(x + 0.5) AS BIGINT) || ':' || CAST(floor(y + 0.5) AS BIGINT) || ':' || CAST(floor(w + 0.5) AS BIGINT) || ':' || CAST(floor(h + 0.5) AS BIGINT)"


@query(f"WITH {_SEL}, r AS (SELECT DISTINCT 'selfp:' || {_RECT} AS s FROM sel) SELECT s, {_fnv_hex('s')} AS fingerprint FROM r")
def selection_fp(spark, sf_dir):
    rect = [scalar.round_half_up(F.col(c)).cast("string") for c in "xywh"]
    d = P.selections(spark, sf_dir).select("photo", *[F.col(c) for c in "xywh"], F.concat_ws(":", F.lit("selfp"), "photo", *rect).alias("s"))
    return d.dropDuplicates(["s"]).select("s", scalar.selection_fingerprint(F.col("photo"), *[F.col(c) for c in "xywh"]).alias("fingerprint"))


@query(f"""WITH {_SEL}, k AS (SELECT uuid, author, w, h, {_RECT} AS fp FROM sel) SELECT uuid, CASE WHEN fp IN (SELECT fp FROM k WHERE author = 'u0') THEN 'map' ELSE 'create' END AS action
  FROM k WHERE author <> 'u0' AND w > 0 AND h > 0""")
def selection_dedup(spark, sf_dir):
    rect = [scalar.round_half_up(F.col(c)).cast("string") for c in "xywh"]
    d = P.selections(spark, sf_dir).withColumn("fp", F.concat_ws(":", "photo", *rect))
    mine = d.filter(F.col("author") == ME).select("fp").distinct().withColumn("there", F.lit(True))
    theirs = d.filter(F.col("author") != ME).filter(scalar.valid_rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return theirs.join(mine, "fp", "left").select("uuid", F.when(F.col("there"), "map").otherwise("create").alias("action"))


@query(f"""WITH {_SEL}, a AS (SELECT *, CAST(substr(photo, 3) AS BIGINT) AS part FROM sel) SELECT uuid, CASE WHEN author = 'u0' THEN 'skip_own' WHEN NOT (w > 0 AND h > 0) THEN 'skip_invalid' WHEN part % 10 = 9 THEN 'no_parent' WHEN part % 10 = 8 THEN 'skip_applied' ELSE 'create' END AS action FROM a""")
def apply_selections(spark, sf_dir):
    part = F.substring("photo", 3, 20).cast("long")
    ok = scalar.valid_rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    action = F.when(F.col("author") == ME, "skip_own").when(~ok, "skip_invalid").when(part % 10 == 9, "no_parent").when(part % 10 == 8, "skip_applied").otherwise("create")
    return P.selections(spark, sf_dir).select("uuid", action.alias("action"))


@query("""SELECT 't_' || conv_id || '_' || turn AS uuid, CASE WHEN role = 'user' THEN 'skip_own' WHEN coalesce(text, '') = '' THEN 'skip_empty' WHEN conv_id % 7 = 6 THEN 'no_parent' WHEN turn % 3 = 1 THEN 'replace' ELSE 'create' END AS action FROM conversations""")
def apply_transcriptions(spark, sf_dir):
    d = P.transcriptions(spark, sf_dir)
    mapped = d.filter("turn % 3 = 1").select("uuid", F.lit(True).alias("mapped")).distinct()
    d = d.join(mapped, "uuid", "left")
    action = F.when(F.col("author") == "user", "skip_own").when(F.coalesce("text", F.lit("")) == "", "skip_empty").when(F.col("conv_id") % 7 == 6, "no_parent").when(F.col("mapped"), "replace").otherwise("create")
    return d.select("uuid", action.alias("action"))


@query(f"""WITH {_STATE}, l AS (SELECT identity, 'NAME' || substr(key, 2) AS name, deleted FROM state WHERE section = 'lists' AND author IS DISTINCT FROM 'u0')
  SELECT identity, name, CASE WHEN deleted THEN 'remove' ELSE 'add' END AS action FROM l WHERE CAST(substr(name, 5) AS INT) % 2 = 1""")
def apply_lists(spark, sf_dir):
    number = F.substring("key", 2, 20)
    here = P.ops(spark, sf_dir).filter("section = 'lists'").filter(number.cast("long") % 2 == 1).select(F.concat(F.lit("NAME"), number).alias("name")).distinct()
    d = state.foreign(_state(spark, sf_dir).filter("section = 'lists'"), ME).select("identity", F.concat(F.lit("NAME"), number).alias("name"), "deleted")
    return d.join(here, "name", "left_semi").select("identity", "name", F.when(F.col("deleted"), "remove").otherwise("add").alias("action"))


@query(f"WITH {_OPS} SELECT identity, key, 'n_' || substr(sha256(identity || '/' || key), 1, 32) AS id FROM ops WHERE section = 'notes' GROUP BY 1, 2")
def id_map(spark, sf_dir):
    d = P.ops(spark, sf_dir).filter("section = 'notes'").select("identity", "key").distinct()
    return d.withColumn("id", F.concat(F.lit("n_"), F.substring(F.sha2(F.concat_ws("/", "identity", "key"), 256), 1, 32)))


@query(f"WITH {_OPS} SELECT identity, count(*) FILTER (WHERE deleted) AS failures, count(*) FILTER (WHERE deleted) >= 3 AS given_up FROM ops GROUP BY 1")
def failed_keys(spark, sf_dir):
    return P.ops(spark, sf_dir).groupBy("identity").agg(F.count_if("deleted").alias("failures")).withColumn("given_up", F.col("failures") >= 3)


@query(f"""WITH {_OPS}, e AS (SELECT author AS name, clock, count(*) OVER (PARTITION BY author) AS n, row_number() OVER (PARTITION BY author ORDER BY clock DESC) AS r FROM ops)
  SELECT name, clock AS inserted FROM e WHERE n <= 500 OR r <= n - ceil(n * 0.2)""")
def lru_evict(spark, sf_dir):
    d = P.ops(spark, sf_dir).select(F.col("author").alias("name"), "key", F.col("clock").alias("inserted"))
    return report.evict(d, 500).drop("key")


# --- writes --------------------------------------------------------------------------------------


@query(f"""WITH {_STATE} SELECT identity, section, key, value, 'u0' AS author, CAST(1000000000 AS BIGINT) AS clock, true AS deleted FROM state WHERE NOT deleted AND clock % 3 = 0""")
def removal_ops(spark, sf_dir):
    s = _state(spark, sf_dir)
    return writes.removals(s, s.filter("clock % 3 = 0"), ME, 1_000_000_000, 0).drop("at")


@query(f"WITH {_STATE} SELECT identity, section, key, clock FROM state WHERE NOT (section = 'notes' AND clock % 3 = 0)")
def hard_delete(spark, sf_dir):
    s = _state(spark, sf_dir)
    return writes.hard_delete(s, s.filter("section = 'notes' and clock % 3 = 0")).select("identity", "section", "key", "clock")


@query(f"""WITH {_OPS} SELECT identity, key, arg_min(CASE section WHEN 'notes' THEN 'note' WHEN 'selections' THEN 'selection' WHEN 'selectionNotes' THEN 'selectionNote' WHEN 'transcriptions' THEN 'transcription' ELSE 'list' END, clock) AS type FROM ops WHERE section <> 'tags' GROUP BY 1, 2""")
def uuid_registry(spark, sf_dir):
    return writes.registry(P.ops(spark, sf_dir))


@query(f"""WITH {_OPS}, d AS (SELECT DISTINCT identity, section, key FROM ops) SELECT identity, count(*) FILTER (WHERE section = 'notes') AS note, count(*) FILTER (WHERE section = 'selections') AS selection, count(*) FILTER (WHERE section = 'selectionNotes') AS "selectionNote", count(*) FILTER (WHERE section = 'transcriptions') AS transcription, count(*) FILTER (WHERE section = 'lists') AS list FROM d WHERE section <> 'tags' GROUP BY 1""")
def vault_recovery(spark, sf_dir):
    return writes.known_keys(writes.registry(P.ops(spark, sf_dir)))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def room_config(spark, sf_dir):
    c = P.read(spark, sf_dir, "customer")
    return writes.merge_config(c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value")), c.filter("c_custkey % 4 = 0").select(F.col("c_name").alias("name"), F.lit("new").alias("value")))


@query("SELECT c_custkey AS room FROM customer WHERE c_custkey % 3 <> 1")
def schema_gate(spark, sf_dir):
    version = F.when(F.col("c_custkey") % 3 == 0, 4).when(F.col("c_custkey") % 3 == 1, 3)
    return writes.readable(P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("room"), version.alias("schema_version"))).select("room")


@query(f"""WITH {_REC} SELECT 'metadata.update' AS action, identity AS target, '{{"identity":"' || identity || '","key":"' || key || '"}}' AS payload FROM rec WHERE {_APPLY} = 'apply'""")
def host_actions(spark, sf_dir):
    return writes.actions(apply_plan_metadata(spark, sf_dir), "metadata")


# --- reports -------------------------------------------------------------------------------------

_SUMMARY = f"WITH {_STATE}, s AS (SELECT author, 0 AS metadata, count(*) FILTER (WHERE section = 'tags') AS tags, count(*) FILTER (WHERE section = 'notes') AS notes, count(*) FILTER (WHERE section = 'selections') AS selections, count(*) FILTER (WHERE section = 'transcriptions') AS transcriptions, count(*) FILTER (WHERE section = 'lists') AS lists FROM state WHERE NOT deleted AND author IS DISTINCT FROM 'u0' AND section <> 'selectionNotes' GROUP BY author)"


@query(_SUMMARY + " SELECT * REPLACE (CAST(metadata AS BIGINT) AS metadata) FROM s")
def author_summary(spark, sf_dir):
    return report.author_summary(_state(spark, sf_dir), ME)


@query(_SUMMARY + " SELECT author, concat_ws(', ', " + ", ".join(f"CASE WHEN {s} > 0 THEN {s} || ' {s}' END" for s in report.SUMMED) + ") AS summary FROM s")
def author_summary_text(spark, sf_dir):
    return report.summary_text(report.author_summary(_state(spark, sf_dir), ME))


@query(f"""WITH {_STATE} SELECT identity, string_agg(DISTINCT author, ', ' ORDER BY author) AS contributors, count(DISTINCT author) AS n FROM state
  WHERE NOT deleted AND author <> 'u0' AND section IN ('notes', 'selections', 'transcriptions', 'tags') GROUP BY 1""")
def contributors(spark, sf_dir):
    return report.contributors(_state(spark, sf_dir), ME)


_FLOOD = "flood AS (SELECT identity, count(*) AS total, count(*) FILTER (WHERE deleted) AS gone, count(*) FILTER (WHERE deleted) / count(*) AS ratio FROM state WHERE author IS DISTINCT FROM 'u0' GROUP BY 1)"


@query(f"WITH {_STATE}, {_FLOOD} SELECT *, total >= 5 AND ratio > 0.2 AS flood FROM flood")
def tombstone_flood(spark, sf_dir):
    return report.tombstone_flood(_state(spark, sf_dir), ME, 5, 0.2)


@query(f"""WITH {_STATE}, {_FLOOD}, {_NOTES}, v AS (SELECT 'item' || (doc_id % 50) AS identity, count(*) AS n_entries, count(*) FILTER (WHERE strlen(text) > 20000) AS n_oversize FROM notes GROUP BY 1)
  SELECT v.*, coalesce(total >= 5 AND ratio > 0.2, false) AS flood, n_oversize = 0 AND NOT coalesce(total >= 5 AND ratio > 0.2, false) AS valid FROM v LEFT JOIN flood USING (identity)""")
def validate_inbound(spark, sf_dir):
    sizes = P.notes(spark, sf_dir).select(F.concat(F.lit("item"), F.col("doc_id") % 50).alias("identity"), F.octet_length("text").alias("size"))
    return report.validate(sizes, report.tombstone_flood(_state(spark, sf_dir), ME, 5, 0.2), 20_000)


_ROOMS = """rooms AS (SELECT 'room' || (user_id % 20) AS room, user_id AS client, event_type AS kind, epoch_us(ts) // 1000 AS "at", event_id AS seq FROM events)"""


def _rooms(spark, sf_dir):
    return P.read(spark, sf_dir, "events").select(F.concat(F.lit("room"), F.col("user_id") % 20).alias("room"), F.col("user_id").alias("client"), F.col("event_type").alias("kind"), P.millis("ts").alias("at"), F.col("event_id").alias("seq"))


@query(f"""WITH {_ROOMS} SELECT room, count(DISTINCT client) AS clients, count(*) FILTER (WHERE kind = 'view') AS total_syncs, min("at") AS created, max("at") AS last_activity FROM rooms GROUP BY 1""")
def room_stats(spark, sf_dir):
    return report.room_stats(_rooms(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "view", "sync").otherwise(F.col("kind"))))


@query(f"""WITH {_ROOMS} SELECT room, client, kind, seq, row_number() OVER (PARTITION BY room ORDER BY "at" DESC, seq DESC) AS rank FROM rooms QUALIFY rank <= 200""")
def room_activity(spark, sf_dir):
    return report.room_activity(_rooms(spark, sf_dir)).drop("at").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_ROOMS} SELECT client AS ip, count(*) AS connections, count(*) > 10 AS limited FROM rooms GROUP BY 1""")
def conn_stats(spark, sf_dir):
    return _rooms(spark, sf_dir).groupBy(F.col("client").alias("ip")).agg(F.count("*").alias("connections")).withColumn("limited", F.col("connections") > 10)


@query(f"WITH {_STATE} SELECT count(DISTINCT identity) AS identities, count(DISTINCT author) AS peers, count(*) AS entries, count(*) FILTER (WHERE deleted) AS tombstones FROM state")
def status(spark, sf_dir):
    return _state(spark, sf_dir).agg(F.countDistinct("identity").alias("identities"), F.countDistinct("author").alias("peers"), F.count("*").alias("entries"), F.count_if("deleted").alias("tombstones"))


@query(f"""WITH {_OPS} SELECT author, arg_max(value, clock) AS display_name, max("at") AS seen FROM ops GROUP BY 1""")
def presence(spark, sf_dir):
    d = P.ops(spark, sf_dir).groupBy("author").agg(F.max(F.struct("clock", "value")).alias("m"), F.max("at").alias("seen"))
    return d.select("author", F.col("m.value").alias("display_name"), "seen")


@query(f"WITH {_OPS} SELECT author, clock, dense_rank() OVER (PARTITION BY author ORDER BY clock // 100) AS push_seq FROM ops")
def push_seq(spark, sf_dir):
    d = P.ops(spark, sf_dir).select("author", "clock").withColumn("push", F.floor(F.col("clock") / 100))
    seq = report.ranked(d.select("author", "push").distinct(), "author", "push", "push_seq")
    return d.join(seq, ["author", "push"]).select("author", "clock", "push_seq")


# --- lists and templates -------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_LISTS}, t AS (SELECT uuid, parent, name, ordinal, 0 AS depth FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT uuid FROM nodes)
  UNION ALL SELECT n.uuid, n.parent, n.name, n.ordinal, t.depth + 1 FROM nodes n JOIN t ON n.parent = t.uuid) SELECT * FROM t""")
def topo_lists(spark, sf_dir):
    return hierarchy.in_order(P.list_nodes(spark, sf_dir))


@query(f"""WITH {_LISTS} SELECT 'l_' || substr(sha256(uuid), 1, 16) AS uuid, 'l_' || substr(sha256(parent), 1, 16) AS parent, name, substr(sha256(uuid || '|' || coalesce(parent, '') || '|' || name), 1, 16) AS hash FROM nodes WHERE ordinal % 3 <> 0""")
def push_lists(spark, sf_dir):
    d = P.list_nodes(spark, sf_dir)
    known = lambda c: F.concat(F.lit("l_"), F.substring(F.sha2(c, 256), 1, 16))
    d = d.withColumn("hash", F.substring(F.sha2(F.concat_ws("|", "uuid", F.coalesce("parent", F.lit("")), "name"), 256), 1, 16))
    last = d.filter("ordinal % 3 = 0").select(F.col("uuid").alias("identity"), "hash")
    return reconcile.changed(d.withColumn("identity", F.col("uuid")), last).select(known(F.col("uuid")).alias("uuid"), known(F.col("parent")).alias("parent"), "name", "hash")


@query(f"""WITH {_LISTS} SELECT uuid, name, CASE WHEN ordinal % 4 = 0 THEN 'skip' WHEN ordinal % 4 = 1 THEN 'map' ELSE 'create' END AS action,
  CASE WHEN ordinal % 4 >= 2 THEN coalesce((SELECT p.ordinal FROM nodes p WHERE p.uuid = nodes.parent AND p.ordinal % 4 = 0), 0) END AS local_parent FROM nodes WHERE ordinal % 5 <> 0""")
def list_apply_plan(spark, sf_dir):
    n = P.list_nodes(spark, sf_dir)
    theirs = n.withColumn("author", F.concat(F.lit("u"), F.col("ordinal") % 5)).withColumn("deleted", F.lit(False))
    mapped = n.filter("ordinal % 4 = 0").select("uuid", F.col("ordinal").alias("local_id"))
    local = n.filter("ordinal % 4 = 1").select("name", F.col("ordinal").alias("local_id"))
    return hierarchy.apply_plan(theirs, mapped, local, ME)


@query("SELECT p_brand AS uri, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 100 = 0) GROUP BY 1")
def templates_to_apply(spark, sf_dir):
    p = P.read(spark, sf_dir, "part")
    here = p.filter("p_partkey % 100 = 0").select(F.col("p_brand").alias("uri")).distinct()
    return p.select(F.col("p_brand").alias("uri")).groupBy("uri").agg(F.count("*").alias("n")).join(here, "uri", "left_anti")


@query("""SELECT p_brand AS uri, substr(sha256(string_agg(DISTINCT p_type, '|' ORDER BY p_type)), 1, 16) AS hash, count(DISTINCT p_type) AS fields FROM part GROUP BY 1""")
def push_templates(spark, sf_dir):
    p = P.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("uri")).agg(F.array_sort(F.collect_set("p_type")).alias("f"))
    return p.select("uri", F.substring(F.sha2(F.array_join("f", "|"), 256), 1, 16).alias("hash"), F.size("f").cast("long").alias("fields"))


# --- text and scalars ----------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({_escape_sql('text')}) AS digest FROM documents")
def html_escape(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.escape_html(F.col("text")), 256).alias("digest"))


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def strip_tags(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("digest"))


@query(f"SELECT page_id, sha256({_normalize_sql('html')}) AS digest FROM pages")
def normalize_html(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select("page_id", F.sha2(text.normalize_html(F.col("html")), 256).alias("digest"))


@query()
def sanitize_html(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select("page_id", text.sanitize_html("html").alias("html"))


#: Attacks on a sanitiser around a name (@), and what is left of them.
_ATTACKS = (
    ('<p onclick="x()">@</p><script>alert(1)</script>', "<p>@</p>"),
    ('<a href="javascript:alert(1)" title="t">@</a>', '<a title="t">@</a>'),
    ('<a href="&#106;avascript&#58;x">@</a><iframe src=x>y</iframe>', "<a>@</a>"),
    ('<span style="text-decoration: underline; color: red" data-x="1">@</span>', '<span style="text-decoration: underline">@</span>'),
    ("<h1>@</h1><!-- c --> 1 < 2", "@ 1 &lt; 2"),
    ('<a href="/p?&#xD800;&#55296;=@">x</a>', '<a href="/p?\ufffd\ufffd=@">x</a>'),
    ('<a href="//evil.example/@">x</a><svg><p>y</p></svg>', "<a>x</a>"),
)


@query("SELECT c_custkey AS id, replace(CASE " + " ".join(f"WHEN c_custkey % {len(_ATTACKS)} = {k} THEN '{clean}'" for k, (_, clean) in enumerate(_ATTACKS)) + " END, '@', c_name) AS html FROM customer")
def sanitize_attacks(spark, sf_dir):
    html = F.element_at(F.array(*[F.lit(attack) for attack, _ in _ATTACKS]), (F.col("c_custkey") % len(_ATTACKS) + 1).cast("int"))
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.sanitize_html(F.replace(html, F.lit("@"), F.col("c_name"))).alias("html"))


@query("SELECT doc_id, '<p>' || " + _escape_sql("text") + " || '</p>' AS html FROM documents")
def render_note(spark, sf_dir):
    node = F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))
    doc = F.to_json(F.struct(F.array(node).alias("content")))
    return P.read(spark, sf_dir, "documents").select("doc_id", text.render_note(doc).alias("html"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace('<p>' || text || '</p>', '(<(?:p|li|h[1-6])>)', '\\1<span style="text-decoration: line-through">', 'gi'), '(</(?:p|li|h[1-6])>)', '</span>\\1', 'gi')) AS digest FROM documents""")
def strike(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strike_through(F.concat(F.lit("<p>"), "text", F.lit("</p>"))), 256).alias("digest"))


@query(f"WITH {_NOTES} SELECT uuid, '<p><sub>[overlay:' || uuid || ' from ' || author || ' — safe to delete, do not edit]</sub></p>' AS footer, uuid AS key FROM notes")
def note_footer(spark, sf_dir):
    d = P.notes(spark, sf_dir).select("uuid", text.footer(F.col("uuid"), F.col("author")).alias("footer"))
    return d.withColumn("key", text.footer_key(F.col("footer")))


@query(f"WITH {_NOTES} SELECT uuid FROM notes WHERE doc_id % 3 <> 0")
def synced_note_filter(spark, sf_dir):
    n = P.notes(spark, sf_dir)
    html = F.when(F.col("doc_id") % 3 == 0, text.footer(F.col("uuid"), F.col("author"))).otherwise(F.lit("<p>x</p>"))
    return n.withColumn("html", html).filter(~text.is_synchronised(F.col("text"), F.col("html"))).select("uuid")


@query("SELECT c_custkey AS id, left(regexp_replace(c_name, '[^a-zA-Z0-9_.-]', '_', 'g'), 128) AS client, CASE WHEN regexp_full_match(c_name, '[a-zA-Z0-9][a-zA-Z0-9_. -]{0,127}') THEN c_name ELSE coalesce(nullif(left(regexp_replace(c_name, '[^a-zA-Z0-9_. -]', '', 'g'), 128), ''), 'default') END AS server FROM customer")
def room_sanitize(spark, sf_dir):
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalar.room_name(F.col("c_name")).alias("client"), scalar.server_room_name(F.col("c_name")).alias("server"))


@query("SELECT event_id AS id, (user_id % 256) || '.' || (event_id % 256) || '.x.x' AS masked FROM events")
def mask_ip(spark, sf_dir):
    ip = F.concat_ws(".", F.col("user_id") % 256, F.col("event_id") % 256, F.lit("7"), F.lit("9"))
    return P.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scalar.mask_ip(ip).alias("masked"))


@query("""SELECT event_id AS id, CASE WHEN event_id < 60 THEN event_id || 's ago' WHEN event_id < 3600 THEN (event_id // 60) || 'm ago' ELSE (event_id // 3600) || 'h ' || (event_id % 3600 // 60) || 'm ago' END AS age FROM events""")
def format_age(spark, sf_dir):
    return P.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scalar.format_age(F.col("event_id")).alias("age"))


@query("SELECT event_id AS id, 1 - 1 / least(pow(2, event_id % 9), 16) AS skip, CAST(least(5000 * pow(2, event_id % 9), 300000) AS BIGINT) AS retry_ms, CAST(least(1000 * pow(2, event_id % 9), 8000) AS BIGINT) AS http_ms FROM events")
def backoff(spark, sf_dir):
    n = F.col("event_id") % 9
    return P.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scalar.skip_probability(n).alias("skip"), scalar.retry_delay_ms(n).alias("retry_ms"), scalar.retry_delay_ms(n, 1000.0, 8000.0).alias("http_ms"))


_WRAP = "(((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(f"SELECT c_custkey AS id, ['{chr(39).join(scalar.PALETTE).replace(chr(39), chr(39) + ', ' + chr(39))}'][1 + abs(list_reduce(list_prepend(CAST(0 AS BIGINT), {_UNITS.format('c_name')}), lambda h, c: {_WRAP})) % 15] AS color FROM customer")
def author_color(spark, sf_dir):
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalar.author_color(F.col("c_name")).alias("color"))


@query(f"SELECT c_custkey AS id, {_fnv_hex('c_name')} AS hash FROM customer")
def fnv_hash(spark, sf_dir):
    return P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalar.fnv1a(F.col("c_name")).alias("hash"))


@query("SELECT c_custkey AS id, 'ws' AS kind, 'h' || c_nationkey || '.example.org' AS host, CASE WHEN c_custkey % 2 = 0 THEN 2468 END AS port, c_name AS room, c_custkey % 2 = 1 AS secure FROM customer")
def connection_strings(spark, sf_dir):
    from palimpsest.sources.readers import connection, connection_string

    address = F.concat(F.lit("h"), "c_nationkey", F.lit(".example.org"), F.when(F.col("c_custkey") % 2 == 0, ":2468").otherwise(""))
    d = P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), connection(connection_string(F.lit("ws"), address, F.col("c_name"))).alias("c"))
    return d.select("id", "c.kind", "c.host", "c.port", "c.room", "c.secure")


@query(f"WITH {_STATE} SELECT * FROM state")
def stream_state(spark, sf_dir):
    from palimpsest.streaming.oplog import replay

    return replay(spark, P.ops(spark, sf_dir))


# the queries of all sections are in a module of their own, which uses the oracles' parts above
from palimpsest.plans import sections  # noqa: E402, F401, I001
from palimpsest.plans import exchange  # noqa: E402, F401
