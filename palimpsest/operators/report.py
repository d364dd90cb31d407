"""Reports: who changed what, who contributed, what looks wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.state import foreign, live

SUMMED = ("metadata", "tags", "notes", "selections", "transcriptions", "lists")
CREDITED = ("notes", "selections", "transcriptions", "tags")


def author_summary(state: DataFrame, me: str) -> DataFrame:
    """Live entries of other authors by section."""
    d = foreign(live(state), me).filter(F.col("section").isin(*SUMMED))
    return d.groupBy("author").agg(*[F.count_if(F.col("section") == s).alias(s) for s in SUMMED])


def summary_text(summary: DataFrame) -> DataFrame:
    part = lambda s: F.when(F.col(s) > 0, F.concat(F.col(s), F.lit(f" {s}")))
    return summary.select("author", F.concat_ws(", ", *[part(s) for s in SUMMED]).alias("summary"))


def contributors(state: DataFrame, me: str) -> DataFrame:
    d = foreign(live(state), me).filter(F.col("section").isin(*CREDITED)).select("identity", "author").distinct()
    return d.groupBy("identity").agg(F.array_join(F.array_sort(F.collect_list("author")), ", ").alias("contributors"), F.count("*").alias("n"))


def tombstone_flood(state: DataFrame, me: str, minimum: int = 20, ratio: float = 0.5) -> DataFrame:
    d = foreign(state, me).groupBy("identity").agg(F.count("*").alias("total"), F.count_if("deleted").alias("gone"))
    d = d.withColumn("ratio", F.col("gone") / F.col("total"))
    return d.withColumn("flood", (F.col("total") >= minimum) & (F.col("ratio") > ratio))


def validate(sizes: DataFrame, floods: DataFrame, limit: int) -> DataFrame:
    """identity, n_entries, n_oversize, flood, valid from sizes (identity, size) and floods."""
    d = sizes.groupBy("identity").agg(F.count("*").alias("n_entries"), F.count_if(F.col("size") > limit).alias("n_oversize"))
    d = d.join(floods.select("identity", "flood"), "identity", "left").withColumn("flood", F.coalesce("flood", F.lit(False)))
    return d.withColumn("valid", (F.col("n_oversize") == 0) & ~F.col("flood"))


#: How warnings name an entry of a section.
NAMED = {"notes": "Note", "selectionNotes": "Selection note", "transcriptions": "Transcription", "metadata": "Metadata"}


def warnings(entries: DataFrame, limits: dict[str, int]) -> DataFrame:
    """identity, warnings, valid of entries (identity, section, key, size, deleted): one warning for each live entry
    above its section's limit. Tombstones, however many, do not make an item invalid."""
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("section")]
    name = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])[F.col("section")]
    text = F.concat(name, F.lit(" "), "key", F.lit(" exceeds max size ("), F.col("size").cast("string"), F.lit(" > "), limit.cast("string"), F.lit(")"))
    found = F.when(~F.coalesce("deleted", F.lit(False)) & (F.col("size") > limit), text)
    d = entries.groupBy("identity").agg(F.array_sort(F.collect_list(found)).alias("warnings"))
    return d.withColumn("valid", F.size("warnings") == 0)


def credits(state: DataFrame, users: DataFrame, me: str) -> DataFrame:
    """identity, author, name, tag, color of those who contributed to an item: the display name of ``users``
    (author, display_name), or the author where it has none."""
    from palimpsest.functions.scalar import author_color

    d = foreign(live(state), me).filter(F.col("section").isin(*CREDITED)).select("identity", "author").distinct()
    d = d.join(users.select("author", "display_name"), "author", "left").withColumn("name", F.coalesce("display_name", "author"))
    return d.select("identity", "author", "name", F.concat(F.lit("@"), "name").alias("tag"), author_color(F.col("author")).alias("color"))


def room_stats(events: DataFrame) -> DataFrame:
    """From room, client, kind, at: connections, syncs, first and last activity."""
    return events.groupBy("room").agg(F.countDistinct("client").alias("clients"), F.count_if(F.col("kind") == "sync").alias("total_syncs"), F.min("at").alias("created"), F.max("at").alias("last_activity"))


def room_activity(events: DataFrame, kept: int = 200) -> DataFrame:
    """The newest events of each room. The rank limit applies in each task before the shuffle."""
    w = Window.partitionBy("room").orderBy(F.desc("at"), F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kept)


#: Values of one block of a rank. A block is ranked in a task; of the blocks before it only their counts are summed.
SPAN = 4096


def ranked(d: DataFrame, by: str, value: str, rank: str) -> DataFrame:
    """``d`` with the place of each row among those of its ``by``, smallest whole number ``value`` first, from 1.

    A key may hold any share of the rows: blocks of ``SPAN`` values are ranked apart, and a block begins
    after the rows of the blocks before it, which are counted before they move. Rows of equal value are in no
    particular order; null values come first.
    """
    d = d.withColumn("block_", F.floor(F.col(value) / SPAN))
    before = Window.partitionBy("by_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy(F.col(by).alias("by_"), "block_").agg(F.count(F.lit(1)).alias("n_")).withColumnRenamed("block_", "at_")
    first = blocks.withColumn("first_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    d = d.withColumn("in_", F.row_number().over(Window.partitionBy(by, "block_").orderBy(value)))
    d = d.join(first, F.col(by).eqNullSafe(F.col("by_")) & F.col("block_").eqNullSafe(F.col("at_")))
    return d.withColumn(rank, F.col("first_") + F.col("in_")).drop("block_", "by_", "at_", "n_", "first_", "in_")


def evict(entries: DataFrame, cap: int, share: float = 0.2) -> DataFrame:
    """Of each map (name, key, inserted) above ``cap`` entries the oldest share goes, in pairs."""
    n = entries.groupBy("name").agg(F.count("*").alias("n"))
    d = ranked(entries, "name", "inserted", "place").join(n, "name")
    return d.filter((F.col("n") <= cap) | (F.col("place") > F.ceil(F.col("n") * share))).select("name", "key", "inserted")
