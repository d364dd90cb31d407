"""Items: nested documents from normalised slices, and what is filtered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRUCTURAL = ("photo", "template", "list", "lists", "tag")
KEPT = (*STRUCTURAL, "note", "selection", "transcription", "id", "type")


def enrich(items: DataFrame, photos: DataFrame, metadata: DataFrame) -> DataFrame:
    """local_id, title, photo: array of (ordinal, checksum, brand, size) in order. Photos whose checksum
    has no metadata stay, with nulls; items without photos stay, with an empty array."""
    p = photos.join(metadata, "checksum", "left")
    nested = p.groupBy("local_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "checksum", "brand", "size"))).alias("photo"))
    return items.join(nested, "local_id", "left").withColumn("photo", F.coalesce("photo", F.array().cast("array<struct<ordinal:int,checksum:string,brand:string,size:int>>")))


def _nested(child: DataFrame, by: str, name: str, columns: list[str]) -> DataFrame:
    return child.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def summaries(items: DataFrame, photos: DataFrame, tags: DataFrame, lists: DataFrame) -> DataFrame:
    """local_id, template, photos, tags and lists (arrays of ids in order) of every item (local_id, template); what
    an item lacks is an empty array. photos: local_id, ordinal, id; tags and lists: local_id, id."""
    out = items.select("local_id", "template")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda p: p["id"])
    for name, ids in (("photos", photos.groupBy("local_id").agg(in_order.alias("photos"))), *((n, d.groupBy("local_id").agg(F.array_sort(F.collect_set("id")).alias(n))) for n, d in (("tags", tags), ("lists", lists)))):
        out = out.join(ids, "local_id", "left").withColumn(name, F.coalesce(name, F.array().cast(ids.schema[name].dataType)))
    return out


def properties(metadata: DataFrame) -> DataFrame:
    """subject, metadata: the properties (subject, prop, text, type) of each subject, in order. Null texts and types are ''; of
    rows with the same property the largest counts."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("text", "type")]
    one = metadata.groupBy("subject", "prop").agg(F.max(F.struct(*text)).alias("v"))
    return one.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("prop", "v.text", "v.type"))).alias("metadata"))


def tree(items: DataFrame, photos: DataFrame, tags: DataFrame, notes: DataFrame, selections: DataFrame, transcriptions: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Whole items: their tags, and photos with notes, transcriptions and selections, which have notes of their own.

    With ``metadata`` (subject, prop, text, type) items, photos and selections also have their properties, null
    without any: the subject of an item is its local_id as text, of a photo its checksum, of a selection its uuid.

    photos: local_id, ordinal, checksum; tags: local_id, name; notes: parent (a checksum or a selection's uuid), uuid,
    text; selections: checksum, uuid; transcriptions: checksum, uuid, text. What an item or photo lacks is an
    empty array. Photos of the same checksum have the same notes.
    """
    note = _nested(notes, "parent", "note", ["uuid", "text"])
    props = None if metadata is None else properties(metadata)
    of = lambda d, key: d if props is None else d.join(props.withColumnRenamed("subject", key), key, "left")
    more = [] if props is None else ["metadata"]
    s = of(selections, "uuid").join(note.withColumnRenamed("parent", "uuid"), "uuid", "left").withColumn("note", F.coalesce("note", F.array().cast(note.schema["note"].dataType)))
    parts = [
        (note.withColumnRenamed("parent", "checksum"), "note"),
        (_nested(s, "checksum", "selection", ["uuid", "note", *more]), "selection"),
        (_nested(transcriptions, "checksum", "transcription", ["uuid", "text"]), "transcription"),
    ]
    p = photos
    for d, name in parts:
        p = p.join(d, "checksum", "left").withColumn(name, F.coalesce(name, F.array().cast(d.schema[name].dataType)))
    p = of(p, "checksum")
    nested = _nested(p, "local_id", "photo", ["ordinal", "checksum", "note", "selection", "transcription", *more])
    named = tags.groupBy("local_id").agg(F.array_sort(F.collect_set("name")).alias("tag"))
    if metadata is not None:
        items = of(items.withColumn("subject_", F.col("local_id").cast("string")), "subject_").drop("subject_")
    out = items.join(nested, "local_id", "left").join(named, "local_id", "left")
    return out.withColumn("photo", F.coalesce("photo", F.array().cast(nested.schema["photo"].dataType))).withColumn("tag", F.coalesce("tag", F.array().cast("array<string>")))


def is_property(key: Column) -> Column:
    """Whether a key of an item is metadata: a compact or full URI, and nothing of the structure."""
    return ~key.rlike("^[@_]") & ~key.isin(*STRUCTURAL) & key.rlike("[:/]")


def strip_structure(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~k.rlike("^[@_]") & ~k.isin(*STRUCTURAL, "id"))


def literal(value: Column) -> Column:
    """text, type and language of a value that is a string, or JSON with @value or text."""
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(value, f"$['{n}']"), F.lit("")) for n in names])
    plain = ~F.coalesce(F.trim(value).startswith("{"), F.lit(False))
    text = F.when(plain, value).otherwise(F.coalesce(get("@value", "text"), F.lit("")))
    kind = F.when(plain, F.lit(None)).otherwise(get("@type", "type"))
    return F.struct(text.alias("text"), F.coalesce(kind, F.lit("http://www.w3.org/2001/XMLSchema#string")).alias("type"), F.when(~plain, get("@language", "language")).alias("language"))


def expand_key(key: Column, base: Column, vocab: str) -> Column:
    """A JSON-LD key in full: ``prefix:name`` by the context's base (segments after the second are lost),
    others by the vocabulary; ``@`` keys, URIs and structural names stay."""
    name = F.split(key, ":")[1]
    return (
        F.when(key.startswith("@") | key.contains("/") | key.isin(*KEPT), key)
        .when(key.contains(":") & base.contains("/"), F.concat(base, name))
        .when(key.contains(":"), key)
        .otherwise(F.concat(F.lit(vocab), key))
    )


def is_preset(uri: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a template came with the host application: by its URI's beginning, or without URI."""
    found = uri.isNull() | (uri == "")
    for p in prefixes:
        found = found | uri.startswith(p)
    return found
