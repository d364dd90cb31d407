"""Linking items of replicas: content hash, alias, then similarity of photo checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalar import identity_of
from palimpsest.session import written


def identities(photos: DataFrame, key: str) -> DataFrame:
    """key, identity of every item with photos."""
    known = photos.filter("checksum is not null and checksum <> ''")
    return known.groupBy(key).agg(identity_of(F.collect_list("checksum")).alias("identity"))


def index(items: DataFrame) -> DataFrame:
    """identity, local_id: of items with equal identity the last one stands."""
    return items.filter("identity is not null").groupBy("identity").agg(F.max("local_id").alias("local_id"))


def exact(remote: DataFrame, local: DataFrame) -> DataFrame:
    return remote.join(local, "identity").select("remote_id", "local_id")


def alias(remote: DataFrame, local: DataFrame, matched: DataFrame, aliases: DataFrame) -> DataFrame:
    """What no match has, by the identity that an alias names now; one hop, the first alias by order,
    and only to items that are still free."""
    rest = remote.join(matched, "remote_id", "left_anti")
    first = aliases.groupBy("old_identity").agg(F.min(F.struct("ordinal", "target")).alias("t")).select("old_identity", F.col("t.target").alias("target"))
    found = rest.join(first, rest["identity"] == first["old_identity"]).select("remote_id", F.col("target").alias("identity")).join(local, "identity").select("remote_id", "local_id")
    found = found.join(matched, "local_id", "left_anti")
    return found.groupBy("local_id").agg(F.min("remote_id").alias("remote_id")).select("remote_id", "local_id")


def _sets(photos: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """key, set: the places of its checksums in their order, rarest first."""
    return photos.join(order, "checksum").groupBy(key).agg(F.sort_array(F.collect_set("place")).alias("set"))


def _heads(sets: DataFrame, threshold: float) -> DataFrame:
    """With head: the first places of a set, one of which is in the head of any set that is similar enough."""
    return sets.withColumn("head", F.slice("set", 1, (F.size("set") - F.ceil(F.size("set") * threshold - 1e-9) + 1).cast("int")))


def similar(remote_photos: DataFrame, local_photos: DataFrame, threshold: float = 0.5) -> DataFrame:
    """remote_id, local_id, score: for each remote item the local one with the largest Jaccard similarity
    of checksum sets, at least ``threshold``; of equal ones the first. Null checksums are ignored.

    An inverted index of set heads: sets are sorted rarest checksum first, and of two similar sets the
    first common checksum is in both heads, so a checksum that very many items share brings pairs only
    where a set has little else. Items with equal sets are compared once. Checksums travel as their
    places in that order, and sets are written once, as several joins read them.
    """
    both = remote_photos.select("checksum").unionByName(local_photos.select("checksum")).filter("checksum is not null")
    counted = both.groupBy("checksum").agg(F.count(F.lit(1)).alias("n")).orderBy("n")
    order = written(counted.select("checksum", F.monotonically_increasing_id().alias("place")), "checksum-order")
    r = written(_sets(remote_photos, "remote_id", order), "remote-sets")
    one = _heads(written(r.groupBy("set").agg(F.min("remote_id").alias("r")), "distinct-remote-sets"), threshold)
    of = _heads(written(_sets(local_photos, "local_id", order).groupBy("set").agg(F.min("local_id").alias("local_id")), "distinct-local-sets"), threshold)
    # what two sets share ends with what follows a common checksum in each, itself included
    left = lambda d, key, rest: d.select(key, F.size("set").alias(f"{rest}_all"), F.posexplode("head").alias("at", "place")).withColumn(rest, F.col(f"{rest}_all") - F.col("at")).drop("at")
    enough = F.least("a", "b") >= (F.col("a_all") + F.col("b_all")) * (threshold / (1 + threshold)) - 1e-9
    pairs = left(one, "r", "a").join(left(of, "local_id", "b"), "place").filter(enough).select("r", "local_id").distinct()
    shared = F.size(F.array_intersect("remote_set", "local_set"))
    scored = pairs.join(one.select("r", F.col("set").alias("remote_set")), "r").join(of.select("local_id", F.col("set").alias("local_set")), "local_id")
    scored = scored.select("r", "local_id", (shared / (F.size("remote_set") + F.size("local_set") - shared)).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("r").agg(F.max(F.struct("score", (-F.col("local_id")).alias("o"))).alias("m"))
    best = one.join(best, "r").select("set", "m")
    return r.select("remote_id", "set").join(best, "set").select("remote_id", (-F.col("m.o")).alias("local_id"), F.col("m.score").alias("score"))


def taken(exact_matches: DataFrame, alias_matches: DataFrame) -> DataFrame:
    """remote_id, local_id, kind of the matches by content and alias that stand: each local item is claimed once."""
    first = exact_matches.groupBy("local_id").agg(F.min("remote_id").alias("remote_id")).withColumn("kind", F.lit("exact"))
    return first.unionByName(alias_matches.withColumn("kind", F.lit("alias"))).select("remote_id", "local_id", "kind")


def resolve(taken: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """All matches with their kind: each local item is claimed once. A fuzzy match whose local item is
    taken, or claimed by a remote item before it, is not offered its second choice."""
    rest = fuzzy.join(taken, "remote_id", "left_anti").join(taken, "local_id", "left_anti")
    claimed = rest.groupBy("local_id").agg(F.min("remote_id").alias("remote_id")).withColumn("kind", F.lit("fuzzy"))
    return taken.unionByName(claimed).select("remote_id", "local_id", "kind")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """All candidates of a remote item in order of preference."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("remote_id").orderBy(F.desc("score"), "local_id")))
