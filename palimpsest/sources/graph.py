"""Exported JSON-LD graphs, read as VARIANT: items in compact or expanded form, single values or arrays, into ops.

A graph's values differ from one item to the next, so no struct fits them all; a VARIANT keeps each
as it is, and what is asked of it is read by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.functions import text as T
from palimpsest.functions.scalar import bound
from palimpsest.operators.items import KEPT, STRUCTURAL, is_property
from palimpsest.session import written

# fixed values
STRING = "http://www.w3.org/2001/XMLSchema#string"
TEXT = "https://schema.org/text"
OP = ["identity", "section", "key", "author", "clock", "value", "deleted", "at"]


def get(v: Column, *names: str) -> Column:
    """The first of ``names`` that an object has with a value that is not null."""
    found = F.array(*[F.try_variant_get(v, f"$['{n}']", "variant") for n in names])
    return F.try_element_at(F.filter(found, lambda f: f.isNotNull() & ~F.is_variant_null(f)), F.lit(1))


def as_string(v: Column) -> Column:
    """A plain value as text; null for objects, arrays and nothing."""
    return bound(v, lambda v: F.when(~is_object(v) & ~is_array(v), F.try_variant_get(v, "$", "string")))


def first_text(v: Column, *names: str) -> Column:
    """The first of ``names`` that an object has with a text that is not empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$['{n}']", "string"), F.lit("")) for n in names])


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    """Looks at the outermost level alone: a schema would be that of all that the value holds."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def each(v: Column, *names: str) -> Column:
    """The values of an array; one value is an array of it, none (or JSON's null) an empty one. With ``names``, of the
    first of them that an object has with a value that is not null."""
    told = []
    for path in [f"$['{n}']" for n in names] or ["$"]:
        one = lambda x: F.when(x.isNotNull() & ~F.is_variant_null(x), F.array(x))
        told += [F.try_variant_get(v, path, "array<variant>"), bound(F.try_variant_get(v, path, "variant"), one)]
    return F.coalesce(*told, F.array().cast("array<variant>"))


def fields(v: Column) -> Column:
    """The members of an object as a map; an empty one of anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def graphs(spark: SparkSession, path: str) -> DataFrame:
    """document (file), graph: the JSON documents of a path; broken ones are left out."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document"), F.try_parse_json("value").alias("graph"))
    return d.filter("graph is not null")


def items_of(graphs: DataFrame) -> DataFrame:
    """document, ordinal, item of each document: those of its ``@graph``, or of the array that it is. A document too
    large for one value comes in parts, each with the ordinal of its ``first`` item."""
    whole = F.col("graph")
    listed = graphs.withColumn("at", F.col("first") if "first" in graphs.columns else F.lit(0))
    listed = listed.select("document", "at", F.posexplode(F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), each(whole, "@graph"))).alias("ordinal", "item"))
    return listed.select("document", (F.col("at") + F.col("ordinal")).alias("ordinal"), "item")


def terms_of(graphs: DataFrame) -> DataFrame:
    """document, term, id, type, container, plain: a document's ``@context`` as a table of terms. ``plain`` terms are
    given by their id alone, and only those serve as prefixes; ``@vocab`` is one of them."""
    context = get(F.col("graph"), "@context")
    members = graphs.withColumn("context", F.explode(each(F.when(~is_array(F.col("graph")), context)))).select("document", F.explode(fields(F.col("context"))).alias("term", "v"))
    plain = ~is_object(F.col("v"))
    d = members.select(
        "document", "term", F.when(plain, as_string(F.col("v"))).otherwise(first_text(F.col("v"), "@id")).alias("id"), F.when(~plain, first_text(F.col("v"), "@type")).alias("type"),
        F.when(~plain, first_text(F.col("v"), "@container")).alias("container"), plain.alias("plain"),
    )
    return d.filter(F.coalesce("id", F.lit("")) != "").dropDuplicates(["document", "term"])


def expand(items: DataFrame, terms: DataFrame) -> DataFrame:
    """document, ordinal, key (in full), value, type, container of every member of every item, with the items' further columns.

    ``prefix:name`` is completed by a plain term whose id has a slash (segments after the second are lost),
    another key by its term, else by the document's ``@vocab``; ``@`` keys, URIs and structural names stay.
    ``type`` is the term's, for values that are plain strings: such a value is typed by its context.
    """
    rest = [c for c in items.columns if c != "item"]
    rows = items.select(*rest, F.explode(fields(F.col("item"))).alias("name", "value"))
    stays = F.col("name").startswith("@") | F.col("name").contains("/") | F.col("name").isin(*KEPT)
    asked = F.when(~stays, F.substring_index("name", ":", 1))
    vocab = terms.filter("term = '@vocab' and plain").select("document", F.col("id").alias("vocab"))
    terms = terms.withColumnRenamed("id", "term_id")
    d = rows.withColumn("term", asked).join(terms, ["document", "term"], "left").join(vocab, "document", "left")
    prefixed = F.col("name").contains(":")
    full = (
        F.when(stays, F.col("name"))
        .when(prefixed & F.col("plain") & F.col("term_id").contains("/"), F.concat("term_id", F.split_part("name", F.lit(":"), F.lit(2))))
        .when(prefixed, F.col("name"))
        .when(F.col("term_id").isNotNull(), F.col("term_id"))
        .otherwise(F.concat(F.coalesce("vocab", F.lit("")), "name"))
    )
    own = ~stays & ~prefixed
    typed = F.when(own & F.col("type").isNotNull() & (F.schema_of_variant("value") == "STRING"), F.col("type"))
    return d.select(*rest, full.alias("key"), "value", typed.alias("type"), F.when(own, F.col("container")).alias("container"))


def literal(value: Column, kind: Column) -> Column:
    """text, type and language of a member: a plain value as text, of an object its value; ``kind`` is what the context
    types plain strings as. An array has no text."""

    def of_object(v: Column) -> Column:
        return F.struct(F.coalesce(first_text(v, "@value", "text"), F.lit("")).alias("text"), F.coalesce(first_text(v, "@type", "type"), F.lit(STRING)).alias("type"), first_text(v, "@language", "language").alias("language"))

    def of_plain(v: Column) -> Column:
        return F.struct(F.coalesce(as_string(v), F.lit("")).alias("text"), F.coalesce(kind, F.lit(STRING)).alias("type"), F.lit(None).cast("string").alias("language"))

    return bound(value, lambda v: F.when(is_object(v), of_object(v)).otherwise(of_plain(v)))


def checksum(v: Column, vocab: str) -> Column:
    """A photo's or selection's checksum: plain, or the value of an object; null without one."""
    told = None
    for path in (f"$['{vocab}checksum']", "$['checksum']"):
        plain, value = F.try_variant_get(v, path, "string"), F.try_variant_get(v, f"{path}['@value']", "string")
        of_object = F.coalesce(F.nullif(value, F.lit("")), F.lit("[object Object]"))
        one = F.when(F.try_variant_get(v, path, "struct<>").isNotNull(), of_object).when(F.try_variant_get(v, path, "array<variant>").isNull(), plain)
        told = one if told is None else F.when(plain.isNotNull(), one).otherwise(told)
    return F.nullif(told, F.lit(""))


def photos_of(item: Column, vocab: str) -> Column:
    return each(item, "photo", f"{vocab}photo")


def checksums(item: Column, vocab: str) -> Column:
    """The checksums of an item's photos and of their selections, in their order, repeats too."""
    own = lambda p: F.concat(F.array(checksum(p, vocab)), F.transform(each(p, "selection", f"{vocab}selection"), lambda s: checksum(s, vocab)))
    return F.filter(F.flatten(F.transform(photos_of(item, vocab), own)), lambda c: c.isNotNull())


def join_list(checksums: Column) -> Column:
    return F.array_join(checksums, ",")


def split_list(text: Column) -> Column:
    """What ``join_list`` joined; empty parts do not count."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda c: c != "")


def _note(n: Column, vocab: str) -> Column:
    """id, text, html of a note in any form."""

    plain = lambda v: bound(v, lambda v: F.nullif(F.when(is_object(v), first_text(v, "@value")).otherwise(as_string(v)), F.lit("")))
    first = lambda n, *names: F.try_element_at(F.filter(F.transform(F.array(*[F.try_variant_get(n, f"$['{c}']", "variant") for c in names]), plain), lambda t: t.isNotNull()), F.lit(1))
    told = lambda n: F.struct(
        first_text(n, "@id", "id").alias("id"), F.coalesce(first(n, "@value", "text", TEXT), F.lit("")).alias("text"), F.coalesce(first(n, "html", f"{vocab}html"), F.lit("")).alias("html"), first_text(n, "language").alias("language")
    )
    return bound(n, told)


def _new_id(prefix: str, *place: Column) -> Column:
    """An id by a hash of where the thing is, so that a run that is repeated gives the same."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in place]), 256), 1, 32))


def computed(d: DataFrame, name: str, value: Column) -> DataFrame:
    """``d`` with a column that is computed once a row: filters on what a generator gives stay behind it."""
    return d.select("*", F.explode(F.array(value)).alias(name))


def export_ops(items: DataFrame, terms: DataFrame, author: str, clock: int, vocab: str, spread: bool = False) -> DataFrame:
    """Ops (identity, section, key, author, clock, value as JSON, deleted, at) that write a graph's items whole, without
    asking what is there: metadata, tags, notes, photo metadata, selections, their notes, transcriptions. Items and
    their photos are written first, so that a graph is parsed once. Items are dealt out anew unless they are ``spread``
    over enough tasks already.

    Items without a checksum have no identity and are left out; of items with the same identity and key the
    later one counts. Notes that carry our markers are echoes and stay out; their html is normalised.
    """
    if not spread:  # parsing costs more than its few bytes tell Spark
        items = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document", "ordinal")
    terms = written(terms, "graph-terms")  # of a known size, so that few of them are not shuffled for
    d = computed(items, "identity", scalar.identity_of(checksums(F.col("item"), vocab)))
    d = written(d.filter("identity is not null"), "graph-items")
    place = ["document", "ordinal", "identity"]

    full = expand(d.select(*place, "item"), terms).filter(is_property(F.col("key")) & ~F.col("key").isin(*STRUCTURAL))
    metadata = computed(full, "v", literal(F.col("value"), F.col("type"))).filter("v.text <> ''").select(*place, F.lit("metadata").alias("section"), "key", F.to_json("v").alias("value"))

    tag = d.select(*place, F.explode(each(F.col("item"), "tag", f"{vocab}tag")).alias("t"))
    named = bound(F.col("t"), lambda t: F.when(is_object(t), F.struct(first_text(t, "name", "@value").alias("name"), first_text(t, "color").alias("color"))).otherwise(F.struct(as_string(t).alias("name"), F.lit(None).cast("string").alias("color"))))
    tags = computed(tag, "c", named).select(*place, "c.*").filter("coalesce(name, '') <> ''").select(*place, F.lit("tags").alias("section"), F.lower("name").alias("key"), F.to_json(F.struct("name", "color")).alias("value"))

    photo = d.select(*place, F.posexplode(photos_of(F.col("item"), vocab)).alias("at_photo", "p"))
    photo = written(photo.withColumn("at_photo", F.col("at_photo").cast("string")).withColumn("photo", checksum(F.col("p"), vocab)), "graph-photos")
    note = photo.select(*place, "photo", F.lit(None).cast("string").alias("selection"), "at_photo", F.posexplode(each(F.col("p"), "note", f"{vocab}note")).alias("at_note", "n"))
    sel = photo.filter("photo is not null").select(*place, "photo", "at_photo", F.posexplode(each(F.col("p"), "selection", f"{vocab}selection")).alias("at_sel", "s"))
    local = first_text(F.col("s"), "@id", "id")
    sel = sel.withColumn("selection", F.when(local.isNotNull(), _new_id("s_", F.lit("id"), local)).otherwise(_new_id("s_", F.col("identity"), F.col("at_photo"), F.col("at_sel"))))
    of_sel = sel.select(*place, "photo", "selection", "at_photo", F.posexplode(each(F.col("s"), "note", f"{vocab}note")).alias("at_note", "n"))
    n = computed(note.unionByName(of_sel), "c", _note(F.col("n"), vocab)).filter(~T.is_synchronised(F.col("c.text"), F.col("c.html")))
    n = computed(n, "html", T.normalize_html(F.col("c.html"))).filter("c.text <> '' or html <> ''")
    uuid = F.when(F.col("c.id").isNotNull(), _new_id("n_", F.lit("id"), F.col("c.id"))).otherwise(_new_id("n_", F.col("identity"), F.coalesce("selection", "at_photo"), F.col("at_note")))
    whole = F.to_json(F.struct("c.text", "html", "c.language", "photo"))
    notes = n.select(
        *place, F.when(F.col("selection").isNull(), "notes").otherwise("selectionNotes").alias("section"), F.concat_ws(":", "selection", uuid).alias("key"),
        F.when(F.col("selection").isNull(), whole).otherwise(F.to_json(F.struct("c.text", "html", "c.language"))).alias("value"),
    )

    of_photo = photo.filter("photo is not null").select(*place, "photo", F.explode(fields(get(F.col("p"), "metadata"))).alias("prop", "v")).filter("prop <> 'id'")
    of_photo = computed(of_photo, "l", literal(F.col("v"), F.lit(None).cast("string"))).filter("l.text <> ''")
    photos = of_photo.select(*place, F.lit("photos").alias("section"), F.concat_ws(":", "photo", "prop").alias("key"), F.to_json(F.struct("l.text", "l.type")).alias("value"))

    number = lambda name: F.try_variant_get("s", f"$['{name}']", "double")
    rect = [number(c) for c in ("x", "y", "width", "height")]
    box = F.struct(*[v.alias(c) for v, c in zip(rect, "xywh", strict=True)], F.coalesce(number("angle"), F.lit(0.0)).alias("angle"), F.col("photo"))
    boxes = computed(sel, "box", box)
    selections = boxes.filter(scalar.valid_rectangle(*[F.col(f"box.{c}") for c in "xywh"])).select(*place, F.lit("selections").alias("section"), F.col("selection").alias("key"), F.to_json("box").alias("value"))

    at = lambda d, v: F.posexplode(each(F.col(v), "transcription", f"{vocab}transcription")).alias("at_tx", "t")
    tx = photo.filter("photo is not null").select(*place, "photo", F.lit(None).cast("string").alias("selection"), "at_photo", at(photo, "p")).unionByName(sel.select(*place, "photo", "selection", "at_photo", at(sel, "s")))
    known = first_text(F.col("t"), "@id", "id")
    key = F.when(known.isNotNull(), _new_id("t_", F.lit("id"), known)).otherwise(_new_id("t_", F.col("identity"), F.coalesce("selection", "at_photo"), F.col("at_tx")))
    body = F.struct(F.coalesce(first_text(F.col("t"), "text"), F.lit("")).alias("text"), F.to_json(get(F.col("t"), "data")).alias("data"), F.col("photo"), F.col("selection"))
    transcriptions = tx.select(*place, F.lit("transcriptions").alias("section"), key.alias("key"), F.to_json(body).alias("value"))

    ops = metadata
    for more in (tags, notes, photos, selections, transcriptions):
        ops = ops.unionByName(more)
    last = ops.groupBy("identity", "section", "key").agg(F.max(F.struct("document", "ordinal", "value")).alias("w"))
    return last.select("identity", "section", "key", F.lit(author).alias("author"), F.lit(clock).cast("long").alias("clock"), "w.value", F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("at"))
