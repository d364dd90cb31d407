"""Writes as data: op-log rows, registries, and the actions that a host would carry out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["identity", "section", "key"]
# fixed values: what the entries of a section are registered as, and the version of the schema
TYPES = {"notes": "note", "selections": "selection", "selectionNotes": "selectionNote", "transcriptions": "transcription", "lists": "list"}
SCHEMA_VERSION = 4


def upserts(entries: DataFrame, author: str, clock: int) -> DataFrame:
    """Ops that replace the whole value of each key."""
    return entries.select(*KEY, F.lit(author).alias("author"), F.lit(clock).cast("long").alias("clock"), "value", F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("at"))


def removals(state: DataFrame, keys: DataFrame, author: str, clock: int, at: int) -> DataFrame:
    """Tombstones of the keys that are there and live; a tombstone keeps the value."""
    d = state.filter(~F.coalesce("deleted", F.lit(False))).join(keys.select(*KEY).distinct(), KEY, "left_semi")
    return d.select(*KEY, F.lit(author).alias("author"), F.lit(clock).cast("long").alias("clock"), "value", F.lit(True).alias("deleted"), F.lit(at).cast("long").alias("at"))


def tombstones(keys: DataFrame, author: str, clock: int, at: int) -> DataFrame:
    """Tombstones of keys whether they are there or not, without a value: templates and lists are removed so."""
    d = keys.select(*KEY).distinct()
    return d.select(*KEY, F.lit(author).alias("author"), F.lit(clock).cast("long").alias("clock"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"), F.lit(at).cast("long").alias("at"))


def hard_delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The state without the keys, which leave no tombstone."""
    return state.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def registry(ops: DataFrame) -> DataFrame:
    """identity, key, type of every identifier as it was first written; later writes change nothing."""
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("section")]
    d = ops.withColumn("type", kind).filter("type is not null")
    return d.groupBy("identity", "key").agg(F.min_by("type", "clock").alias("type"))


def known_keys(registered: DataFrame) -> DataFrame:
    """How many identifiers of each type a replica that lost its memory recovers from the registry."""
    return registered.groupBy("identity").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES.values()])


def merge_config(config: DataFrame, updates: DataFrame) -> DataFrame:
    """name, value: updates replace settings of the same name, others stay."""
    return config.join(updates, "name", "left_anti").unionByName(updates)


def readable(config: DataFrame) -> DataFrame:
    """Rooms whose schema version is ours, or that have none."""
    return config.filter(F.col("schema_version").isNull() | (F.col("schema_version") == SCHEMA_VERSION))


def actions(plan: DataFrame, kind: str) -> DataFrame:
    """action, target, payload (JSON) of a plan's rows that change something here."""
    names = {"apply": "update", "create": "create", "add": "add", "remove": "remove", "replace": "update", "map": "map"}
    action = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("action")]
    rest = [c for c in plan.columns if c != "action"]
    return plan.select(F.concat(F.lit(f"{kind}."), action).alias("action"), F.col(rest[0]).alias("target"), F.to_json(F.struct(*rest)).alias("payload")).filter("action is not null")


# fixed values: what a host is asked to do for a row of a stage, in its order
HOST_ACTIONS = {
    ("apply_metadata", "apply"): ("metadata.save",),
    ("apply_photos", "apply"): ("metadata.save",),
    ("apply_selection_metadata", "apply"): ("metadata.save",),
    ("apply_tags", "add"): ("item.tag.create",),
    ("apply_tags", "remove"): ("item.tag.delete",),
    ("apply_notes", "create"): ("note.create",),
    ("apply_notes", "update"): ("note.delete", "note.create"),
    ("apply_selections", "create"): ("selection.create",),
    ("apply_selection_notes", "create"): ("note.create",),
    ("apply_selection_notes", "update"): ("note.delete", "note.create"),
    ("apply_transcriptions", "create"): ("transcription.create",),
    ("apply_transcriptions", "replace"): ("transcription.delete", "transcription.create"),
    ("apply_lists", "add"): ("list.item.add",),
    ("apply_lists", "remove"): ("list.item.remove",),
}


def host_actions(rows: DataFrame) -> DataFrame:
    """stage, item, key, step, type of what a host does for the rows of a cycle (stage, item, key, action): most rows are one
    action, an update of a note or transcription is a delete and a create. Rows that change nothing here give none."""
    types = F.lit(None).cast("array<string>")
    for (stage, action), names in HOST_ACTIONS.items():
        types = F.when((F.col("stage") == stage) & (F.col("action") == action), F.array(*map(F.lit, names))).otherwise(types)
    told = rows.filter(F.col("stage").isin(*sorted({stage for stage, _ in HOST_ACTIONS})) & F.col("action").isin(*sorted({action for _, action in HOST_ACTIONS})))  # files of other stages are not read
    d = told.select("stage", "item", "key", F.posexplode(types).alias("step", "type"))
    return d.withColumn("step", F.col("step") + 1)
