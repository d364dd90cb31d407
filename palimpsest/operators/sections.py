"""Push and apply decisions for every section, by joins of local, remote and last pushed entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.reconcile import field_hash


def content_hash(columns: Sequence[str]) -> Column:
    """What is remembered of a pushed or applied entry: a hash of its columns."""
    return F.when(F.coalesce(*columns).isNotNull(), field_hash(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), "entry"))


def push_plan(local: DataFrame, remote: DataFrame, pushed: DataFrame, keys: Sequence[str], columns: Sequence[str], me: str, hashed: Sequence[str] | None = None) -> DataFrame:
    """keys, action of each local entry.

    local: keys, columns, skip (why it is not pushed, or null). remote: keys, columns, author, deleted. pushed:
    keys, hash (``content_hash`` of the ``hashed`` columns). An entry equal to a live remote one is
    skip_equal; where another author's live entry differs and ours is as we pushed it, theirs wins
    (conflict_remote); all else is pushed, tombstones are overwritten.
    """
    theirs = remote.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.col("author").alias("r_author"), (~F.coalesce("deleted", F.lit(False))).alias("live"))
    d = local.join(theirs, list(keys), "left").join(pushed.select(*keys, F.col("hash").alias("last")), list(keys), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    live = F.coalesce("live", F.lit(False))
    unchanged = F.coalesce(content_hash(hashed or columns) == F.col("last"), F.lit(False))
    action = F.when(F.col("skip").isNotNull(), F.col("skip")).when(live & same, "skip_equal").when(live & ~F.col("r_author").eqNullSafe(me) & unchanged, "conflict_remote").otherwise("push")
    return d.select(*keys, action.alias("action"))


def apply_fields(remote: DataFrame, parents: DataFrame, local: DataFrame, pushed: DataFrame, keys: Sequence[str], me: str) -> DataFrame:
    """keys, action of each remote field (keys, text, author) of subjects that are here.

    ``parents`` has the subjects' columns of the keys; local: keys, text; pushed: keys, hash. A field that is not
    here is applied; one that differs from what we pushed, or that we never pushed, stays (conflict_local).
    """
    subject = [k for k in keys if k in parents.columns]
    here = parents.select(*subject).distinct().withColumn("parent", F.lit(True))
    mine = local.select(*keys, F.col("text").alias("here"), content_hash(["text"]).alias("now"))
    d = remote.join(here, subject, "left").join(mine, list(keys), "left").join(pushed.select(*keys, F.col("hash").alias("last")), list(keys), "left")
    action = (
        F.when(F.col("author").eqNullSafe(me), "skip_own")
        .when(F.col("parent").isNull(), "no_parent")
        .when(F.col("here").isNull(), "apply")
        .when(F.col("here") == F.coalesce("text", F.lit("")), "skip_equal")
        .when(F.col("last").isNull() | (F.col("now") != F.col("last")), "conflict_local")
        .otherwise("apply")
    )
    return d.select(*keys, action.alias("action"))


#: A form's digest is joined together with one of so many numbers, so a form that very many notes have is no hot key.
SALTS = 16


def digest(form: Column) -> Column:
    return F.unhex(F.sha2(form, 256))


def known_forms(notes: DataFrame) -> DataFrame:
    """item, form: digests of every form that an item's notes (item, text, html) have here: text and html, trimmed, as
    they are and without our markers."""
    forms = F.array(F.trim("text"), T.without_text_marks(F.col("text")), F.trim("html"), T.without_marks(F.col("html"), "html"))
    forms = F.filter(forms, lambda f: F.coalesce(f, F.lit("")) != "")
    return notes.select("item", F.explode(F.array_distinct(F.transform(forms, digest))).alias("form")).distinct()


def note_contents(remote: DataFrame) -> DataFrame:
    """``remote`` with ``safe``, the sanitised html of a note (its text as a paragraph without one), and ``content``,
    that with the footer of the note's key and author."""
    html = F.when(F.coalesce("html", F.lit("")) != "", T.sanitize_html(F.col("html"))).otherwise(F.concat(F.lit("<p>"), T.escape_html(F.coalesce("text", F.lit(""))), F.lit("</p>")))
    author = F.when(F.coalesce("author", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("author"))
    return remote.withColumn("safe", html).withColumn("content", F.concat("safe", T.footer(F.col("key"), T.escape_html(author))))


def parents(notes: DataFrame, photos: DataFrame, photo: str = "photo") -> DataFrame:
    """``notes`` (item, ``photo``) with ``parent``: the photo of that checksum in the note's own item (item, ordinal,
    checksum), the item's first photo for a note that names none, null if there is no such photo."""
    first = photos.groupBy("item").agg(F.min(F.struct("ordinal", "checksum"))["checksum"].alias("first_"))
    there = photos.select("item", F.col("checksum").alias(photo)).distinct().withColumn("there_", F.lit(True))
    d = notes.join(first, "item", "left").join(there, ["item", photo], "left")
    return d.withColumn("parent", F.when(F.col("there_"), F.col(photo)).when(F.col(photo).isNull(), F.col("first_"))).drop("first_", "there_")


def note_plan(remote: DataFrame, local: DataFrame, applied: DataFrame, photos: DataFrame, me: str) -> DataFrame:
    """item, key, action, parent, html of each live remote note (item, key, text, html, photo, author).

    local: item, key (of the footer or the vault; null for notes of our own), text, html. applied: key, hash of
    the html that was last applied. photos: item, ordinal, checksum. A note that is here already is
    skip_present unless it was retracted; one whose item lacks its photo, or has none, is no_parent; one
    edited here since it was applied stays (conflict_local), others are updated. A new one is not
    created twice: dedup if its sanitised html, with or without the footer, or its text is a form of a
    note of its own item. parent and html are what to write, null where nothing is.

    Forms meet by digests within an item and never as texts; an item with very many notes meets in
    ``SALTS`` parts.
    """
    mine = local.filter("key is not null").groupBy("key").agg(F.max(F.struct("text", "html")).alias("mine")).select("key", F.col("mine.text").alias("l_text"), F.col("mine.html").alias("l_html"), F.lit(True).alias("here"))
    d = parents(note_contents(remote), photos).join(mine, "key", "left").join(applied.select("key", F.col("hash").alias("last")), "key", "left")
    l_text, r_text = F.coalesce("l_text", F.lit("")), F.coalesce("text", F.lit(""))
    salt = F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int")
    asked = F.filter(F.array(F.trim("safe"), F.trim("content"), F.trim("text")), lambda f: F.coalesce(f, F.lit("")) != "")
    asked = d.filter("here is null").select("item", "key", F.explode(F.array_distinct(F.transform(asked, digest))).alias("form")).withColumn("salt", salt)
    known = asked.join(known_forms(local).withColumn("salt", salt), ["item", "salt", "form"], "left_semi").select("item", "key").distinct().withColumn("known", F.lit(True))
    action = (
        F.when(F.col("author").eqNullSafe(me), "skip_own")
        .when((r_text == "") & (F.coalesce("html", F.lit("")) == ""), "skip_empty")
        .when(F.col("here") & (r_text != "") & l_text.contains(r_text) & ~l_text.contains("[retracted"), "skip_present")
        .when(F.col("parent").isNull(), "no_parent")
        .when(F.col("here") & F.col("last").isNotNull() & (F.col("last") != field_hash(F.col("l_html"), "note")), "conflict_local")
        .when(F.col("here"), "update")
        .when(F.col("known"), "dedup")
        .otherwise("create")
    )
    d = d.join(known, ["item", "key"], "left").withColumn("action", action)
    write = F.col("action").isin("update", "create")
    return d.select("item", "key", "action", F.when(write, F.col("parent")).alias("parent"), F.when(write, F.col("content")).alias("html"))


def applied_notes(plan: DataFrame, applied: DataFrame, cycle: int) -> DataFrame:
    """key, hash, cycle of every note that was applied, after ``plan`` is carried out: what it writes replaces what was
    remembered (key, hash, cycle); a note that stays as edited here, is present or a duplicate, counts as applied but
    its hash stays as it was, null if there was none."""
    done = plan.filter(F.col("action").isin("update", "create", "conflict_local", "skip_present", "dedup"))
    now = done.groupBy("key").agg(F.max(F.when(F.col("html").isNotNull(), field_hash(F.col("html"), "note"))).alias("now"))
    d = applied.join(now.withColumn("done", F.lit(True)), "key", "full")
    return d.select("key", F.coalesce("now", "hash").alias("hash"), F.when(F.col("now").isNotNull() | (F.col("done") & F.col("cycle").isNull()), F.lit(cycle)).otherwise(F.col("cycle")).cast("long").alias("cycle"))


def first_photo(notes: DataFrame, photos: DataFrame) -> DataFrame:
    """uuid, parent: the photo (item, ordinal, checksum) of the note's item that has its checksum, else the item's
    first one; null for an item without photos."""
    first = photos.groupBy("item").agg(F.min(F.struct("ordinal", "checksum"))["checksum"].alias("first"))
    there = photos.select("item", F.col("checksum").alias("photo")).distinct().withColumn("there", F.lit(True))
    d = notes.join(first, "item", "left").join(there, ["item", "photo"], "left")
    return d.select("uuid", F.when(F.col("there"), F.col("photo")).otherwise(F.col("first")).alias("parent"))


def selection_plan(remote: DataFrame, valid: Column, parents: DataFrame, applied: DataFrame, local: DataFrame, me: str) -> DataFrame:
    """item, uuid, action of remote selections (item, uuid, photo, author, deleted, fp and the columns of ``valid``).

    Tombstones and what was applied before (uuid) do nothing, so later moves are not applied. parents: item,
    photo; local: item, fp, the places of the item's own selections, to which an equal one is mapped.
    """
    d = remote.withColumn("fine", valid)
    d = d.join(parents.select("item", "photo").distinct().withColumn("parent", F.lit(True)), ["item", "photo"], "left")
    d = d.join(applied.select("uuid").distinct().withColumn("done", F.lit(True)), "uuid", "left").join(local.select("item", "fp").distinct().withColumn("mine", F.lit(True)), ["item", "fp"], "left")
    action = (
        F.when(F.coalesce("deleted", F.lit(False)), "skip_deleted").when(F.col("author").eqNullSafe(me), "skip_own").when(F.col("done"), "skip_applied").when(~F.coalesce("fine", F.lit(False)), "skip_invalid")
        .when(F.col("parent").isNull(), "no_parent").when(F.col("mine"), "map").otherwise("create")
    )
    return d.select("item", "uuid", action.alias("action"))


def standing_selections(plan: DataFrame) -> DataFrame:
    """item, uuid of the selections that are here once a ``selection_plan`` was carried out: created, mapped, or applied before."""
    return plan.filter(F.col("action").isin("create", "map", "skip_applied")).select("item", "uuid").distinct()


def selection_note_plan(remote: DataFrame, selections: DataFrame, local: DataFrame, me: str) -> DataFrame:
    """item, key, action of live remote notes on selections (item, selection, key, text, html, author).

    selections: item, uuid of those that are here, which have to be known first; local: key, text of notes
    here, by the key in their footers. A note needs its selection (no_parent); one that is here is updated unless
    its text is in it already and was not retracted (skip_present).
    """
    there = selections.select("item", F.col("uuid").alias("selection")).distinct().withColumn("parent", F.lit(True))
    mine = local.groupBy("key").agg(F.max("text").alias("l_text")).withColumn("here", F.lit(True))
    d = remote.join(there, ["item", "selection"], "left").join(mine, "key", "left")
    l_text, r_text = F.coalesce("l_text", F.lit("")), F.coalesce("text", F.lit(""))
    action = (
        F.when(F.col("author").eqNullSafe(me), "skip_own")
        .when((r_text == "") & (F.coalesce("html", F.lit("")) == ""), "skip_empty")
        .when(F.col("parent").isNull(), "no_parent")
        .when(F.col("here") & (r_text != "") & l_text.contains(r_text) & ~l_text.contains("[retracted"), "skip_present")
        .when(F.col("here"), "update")
        .otherwise("create")
    )
    return d.select("item", "key", action.alias("action"))


def transcription_plan(remote: DataFrame, parents: DataFrame, applied: DataFrame, mapped: DataFrame, me: str) -> DataFrame:
    """item, uuid, action of remote transcriptions (item, uuid, text, photo, author, deleted): a mapped one is replaced,
    another is created on its photo of the item (parents: item, photo)."""
    d = remote.join(parents.select("item", "photo").distinct().withColumn("parent", F.lit(True)), ["item", "photo"], "left")
    d = d.join(applied.select("uuid").distinct().withColumn("done", F.lit(True)), "uuid", "left").join(mapped.select("uuid").distinct().withColumn("known", F.lit(True)), "uuid", "left")
    action = (
        F.when(F.coalesce("deleted", F.lit(False)), "skip_deleted").when(F.col("author").eqNullSafe(me), "skip_own").when(F.coalesce("text", F.lit("")) == "", "skip_empty").when(F.col("done"), "skip_applied")
        .when(F.col("parent").isNull(), "no_parent").when(F.col("known"), "replace").otherwise("create")
    )
    return d.select("item", "uuid", action.alias("action"))


def list_membership_plan(remote: DataFrame, lists: DataFrame, members: DataFrame, me: str, deletions: bool = True) -> DataFrame:
    """identity, name, action of remote memberships (identity, name, author, deleted) in lists that are here (name):
    add where the item is not in the list, remove for a tombstone where it is. ``members``: identity, name."""
    d = remote.filter(~F.col("author").eqNullSafe(me)).join(lists.select("name").distinct(), "name", "left_semi")
    d = d.join(members.select("identity", "name").distinct().withColumn("member", F.lit(True)), ["identity", "name"], "left")
    gone = F.coalesce("deleted", F.lit(False))
    action = F.when(~gone & F.col("member").isNull(), "add").when(gone & F.col("member") & F.lit(deletions), "remove").otherwise("skip")
    return d.select("identity", "name", action.alias("action"))


def lookup(names: DataFrame, here: DataFrame, fold: bool) -> DataFrame:
    """name, local_id (the smallest, null if none) of names; ``fold`` compares in lower case, as tags do."""
    key = lambda c: F.lower(c) if fold else F.col(c)
    ids = here.groupBy(key("name").alias("k")).agg(F.min("local_id").alias("local_id"))
    return names.select("name", key("name").alias("k")).distinct().join(ids, "k", "left").select("name", "local_id")


def aliases(links: DataFrame) -> DataFrame:
    """identity, old_identity, target, created of links that also have a clock: an alias is stored under the new
    identity; of several writes of one the last counts. Aliases of the first format have no time (created is null)."""
    last = links.groupBy("identity", "old_identity").agg(F.max(F.struct("clock", "target", "created")).alias("l"))
    return last.select("identity", "old_identity", F.col("l.target").alias("target"), F.col("l.created").alias("created"))


def purged_aliases(aliases: DataFrame, cutoff: int | Column | None, server: bool = False) -> DataFrame:
    """The aliases (created in ms) to remove, by age alone: those without time and those from before the cutoff. A
    client without a cutoff removes all; a server always has one."""
    if cutoff is None:
        if server:
            raise ValueError("a server purges aliases by age: it needs a cutoff")
        return aliases
    return aliases.filter((F.coalesce("created", F.lit(0)) == 0) | (F.col("created") < cutoff))


def full_apply(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The identities that were not there before: any of them forces a full apply."""
    return current.select("identity").distinct().join(previous.select("identity").distinct(), "identity", "left_anti")


def document_hash(state: DataFrame) -> DataFrame:
    """entries, digest of a whole state. The digest adds up hashes of entries, so it needs no order and no
    gathering; equal states have equal digests."""
    columns = ["identity", "section", "key", "clock", "author", "value", "deleted"]
    parts = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    number = F.conv(F.substring(parts, 1, 12), 16, 10).cast("decimal(38,0)")
    return state.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def local_changes(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change (added, changed, removed) between two snapshots of local slices (keys, hash)."""
    p = previous.select(*keys, F.col("hash").alias("was"))
    d = current.join(p, list(keys), "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("was") != F.col("hash"), "changed")
    return d.select(*keys, change.alias("change")).filter("change is not null")


def assign_ids(keys: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """key, id, created: the id that a key is known by, else a new one by hash of the key. ``known`` read by id is
    the reverse map."""
    d = keys.select("key").distinct().join(known.groupBy("key").agg(F.min("id").alias("old")), "key", "left")
    return d.select("key", F.coalesce("old", F.concat(F.lit(prefix), F.substring(F.sha2("key", 256), 1, 32))).alias("id"), F.col("old").isNull().alias("created"))


def snapshot_ops(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """An op-log of a pulled snapshot of another replica's state and our own ops; merging it is the pull."""
    theirs = snapshot.select("identity", "section", "key", "author", "clock", "value", "deleted", F.col("deleted_at").alias("at"))
    return ops.select(*theirs.columns).unionByName(theirs)
