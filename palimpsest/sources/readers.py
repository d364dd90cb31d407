"""Readers of what replicas leave behind: op-logs, vault files, backups, connection strings, JSON-LD."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = "identity string, section string, key string, author string, clock long, value string, deleted boolean, at long"
VAULT = (
    "version int, pushSeq long, appliedNoteKeys array<string>, appliedSelectionKeys array<string>, appliedTranscriptionKeys array<string>, failedNoteKeys array<string>, noteMappings array<array<string>>, "
    "txMappings array<array<string>>, selMappings array<array<string>>, listMappings array<array<string>>, listUuidMappings array<array<string>>, dismissedKeys array<string>, retractedNoteKeys array<string>, "
    "appliedNoteHashes array<array<string>>, originalAuthors array<array<string>>, pushedTemplateHashes array<array<string>>, pushedListHashes array<array<string>>"
)
#: Parts of a vault that are lists of keys, and those that are lists of pairs.
KEY_LISTS = ("appliedNoteKeys", "appliedSelectionKeys", "appliedTranscriptionKeys", "retractedNoteKeys")
PAIR_LISTS = ("noteMappings", "txMappings", "selMappings", "listMappings", "listUuidMappings", "appliedNoteHashes", "originalAuthors", "pushedTemplateHashes", "pushedListHashes")
#: The failures of a key that an older vault names without a count.
GIVEN_UP = 3
SLICES = ("items", "photos", "selections", "notes", "metadata", "tags", "lists", "activities")
EMPTY = {"templates": "uri string, name string", "lists": "uuid string, parent string, name string"}


def op_log(spark: SparkSession, path: str) -> DataFrame:
    """A durable op-log: files that are only ever added. A late reader sees all of it."""
    return spark.read.schema(OPS).parquet(path)


def op_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same log as a stream of its new files."""
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def slice_or_empty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A slice of local state; an empty one where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path)
    return spark.createDataFrame([], EMPTY[name])


def missing_slices(names: list[str]) -> list[str]:
    return sorted(set(SLICES) - set(names))


def parse_vault(json: F.Column) -> F.Column:
    """A vault of version 1 to 4 from its JSON text; null for another version or a broken text.

    What an older version lacks is empty. failed and dismissed hold (key, n): a key alone, a pair or an object of
    key and count, of which a missing count is ``GIVEN_UP`` failures, and a dismissal without number is 0.
    """
    v = F.from_json(json, VAULT)
    keys = lambda c: F.coalesce(v[c], F.array().cast("array<string>")).alias(c)
    pair = lambda e: F.struct(e[0].alias("key"), e[1].alias("value"))
    pairs = lambda c: F.transform(F.coalesce(v[c], F.array().cast("array<array<string>>")), pair).alias(c)

    def counted(c: str, default: int) -> F.Column:
        def one(e):
            both, named = F.from_json(e, "array<string>"), F.from_json(e, "key string, count int")
            n = F.when(e.startswith("["), both[1].cast("int")).when(e.startswith("{"), named["count"])
            key = F.when(e.startswith("["), both[0]).when(e.startswith("{"), named["key"]).otherwise(e)
            return F.struct(key.alias("key"), F.coalesce(F.nullif(n, F.lit(0)), F.lit(default)).alias("n"))

        return F.transform(F.coalesce(v[c], F.array().cast("array<string>")), one).alias(c)

    known = F.struct(v["version"].alias("version"), F.coalesce(v["pushSeq"], F.lit(0)).alias("pushSeq"), *map(keys, KEY_LISTS), counted("failedNoteKeys", GIVEN_UP), counted("dismissedKeys", 0), *map(pairs, PAIR_LISTS))
    return F.when(v["version"].between(1, 4), known)


def vault(spark: SparkSession, path: str) -> DataFrame:
    """The vaults of the files of a path, each a JSON text; broken ones are left out."""
    return spark.read.text(path, wholetext=True).select(parse_vault(F.col("value")).alias("v")).filter("v is not null").select("v.*")


def vault_text(vault: DataFrame) -> DataFrame:
    """value: each vault as the JSON text of version 4, which ``parse_vault`` reads."""
    back = lambda c: F.transform(c, lambda e: F.array(e["key"], e["value"])).alias(c)
    failed = F.transform("failedNoteKeys", lambda e: F.struct(e["key"].alias("key"), e["n"].alias("count"))).alias("failedNoteKeys")
    dismissed = F.transform("dismissedKeys", lambda e: F.array(e["key"], e["n"].cast("string"))).alias("dismissedKeys")
    return vault.select(F.to_json(F.struct(F.lit(4).alias("version"), "pushSeq", *KEY_LISTS, failed, dismissed, *map(back, PAIR_LISTS))).alias("value"))


def backups(spark: SparkSession, path: str) -> DataFrame:
    """Backup files, newest name first."""
    return spark.read.format("binaryFile").load(path).select("path", "length").orderBy(F.desc("path"))


def json_ld(spark: SparkSession, path: str) -> DataFrame:
    """The items of exported JSON-LD graphs, one row each, as JSON text."""
    d = spark.read.schema("`@graph` array<string>").option("multiLine", True).json(path)
    return d.select(F.explode("`@graph`").alias("item"))


SCHEME = "overlay"


def _parameter(query: F.Column, name: str) -> F.Column:
    return F.url_decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1), F.lit("")))


def connection(s: F.Column, scheme: str = SCHEME) -> F.Column:
    """kind, host, port, room, path, secure, token of a connection string: ``scheme://ws/host[:port]/room?token=…``,
    also ``file`` and ``snapshot`` (its ``auth`` is the token), or a bare ws(s) URL. Scheme and kind are read
    in any case. Null where it is none."""
    s = F.trim(s)
    head = rf"(?i)^{scheme}://(ws|file|snapshot)/"
    kind = F.lower(F.regexp_extract(s, head, 1))
    rest = F.regexp_extract(s, head + "(.*)$", 2)
    bare = F.regexp_extract(s, r"(?i)^wss?://(.*)$", 1)
    whole = F.when(kind == "ws", rest).when(bare != "", bare)
    body, query = F.substring_index(whole, "?", 1), F.regexp_extract(F.coalesce(whole, rest), r"^[^?]*\?(.*)$", 1)
    host, port = F.regexp_extract(body, r"^([^:/?]+)", 1), F.regexp_extract(body, r"^[^:/?]+:([0-9]+)", 1)
    room = F.regexp_extract(body, r"^[^?/]+/([^?]*)", 1)
    secure = F.when(F.lower(s).startswith("ws://"), F.lit(False)).when(F.lower(s).startswith("wss://"), F.lit(True)).otherwise(port == "")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    web = F.struct(F.lit("ws").alias("kind"), host.alias("host"), F.nullif(port, F.lit("")).cast("int").alias("port"), F.url_decode(room).alias("room"), none("string", "path"), secure.alias("secure"), _parameter(query, "token").alias("token"))
    path = F.when(kind == "file", F.concat(F.lit("/"), F.ltrim(F.url_decode(F.substring_index(rest, "?", 1)), F.lit("/")))).otherwise(F.substring_index(rest, "?", 1))
    other = F.struct(kind.alias("kind"), none("string", "host"), none("int", "port"), none("string", "room"), path.alias("path"), none("boolean", "secure"), _parameter(query, "auth").alias("token"))
    return F.when(body.isNotNull() & (host != ""), web).when(kind.isin("file", "snapshot") & (rest != ""), other)


def connection_string(kind: F.Column, address: F.Column, room: F.Column, token: F.Column | None = None, scheme: str = SCHEME) -> F.Column:
    """The string that ``connection`` reads; for ``file`` and ``snapshot`` the address is the path or URL."""
    rooms = F.when(kind == "ws", F.concat(F.lit("/"), F.url_encode(room))).otherwise(F.lit(""))
    name = F.when(kind == "snapshot", "?auth=").when(kind == "ws", "?token=")
    secret = F.lit("") if token is None else F.coalesce(F.concat(name, F.url_encode(token)), F.lit(""))
    return F.concat(F.lit(f"{scheme}://"), kind, F.lit("/"), address, rooms, secret)
