"""Filter interaction audit: what every order of a set of filters keeps, removes and wastes.

Each filter has a table of the ids that fail it. The survivors of a prefix of an order are the rows
left by anti joins with the tables of its filters, which depend only on the set of filters in it:
``2 ** n`` sets serve all ``n!`` orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at it alone: A short, B repetitive, C shouting, D with symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n_words = F.size(words)
    return {
        "A": n_words < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n_words * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def failing_ids(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The written rows (row, doc_id, part), and for each filter the written table of the rows that fail it.

    A row's number is given when the rows are written, so rows that repeat a doc_id stay apart. E
    fails where a smaller doc_id has the same text, told by its SHA-256; the first of each text is
    found by sums before the shuffle, so a text that a third of all rows share moves as one row a task.
    """
    text = F.coalesce("text", F.lit(""))
    facts = only(docs, doc_id="long", text="string", source="string").select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *[fails.alias(name) for name, fails in text_filters(text).items()],
    )
    facts = scratch.table(facts, "facts")
    failing = {name: scratch.table(facts.filter(name).select("row"), f"fails-{name}") for name in "ABCD"}
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = facts.alias("f").join(firsts.select("digest", "first").alias("g"), (F.col("f.digest") == F.col("g.digest")) & (F.col("f.doc_id") > F.col("g.first")), "left_semi")
    failing["E"] = scratch.table(copies.select("row"), "fails-E")
    return facts.select("row", "doc_id", "part"), failing


def stacked(failing: dict[str, DataFrame]) -> DataFrame:
    """The tables of ``failing`` under each other: (failed, f), f the place of the filter."""
    tables = [ids.select(F.col("row").alias("failed"), F.lit(i).alias("f")) for i, ids in enumerate(failing.values())]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def after_prefixes(rows: DataFrame, failures: DataFrame, prefixes: Column, how: str) -> DataFrame:
    """``rows`` once for each of ``prefixes`` (sets of filters, as bits): by ``left_anti`` those that every filter of
    the set passes, by ``left_semi`` those that one of them removes.

    Rows are dealt out by number before the sets are made, so what one row becomes never moves.
    """
    rows = rows.repartition("row").withColumn("prefix", F.explode(prefixes))
    return rows.join(failures, (F.col("row") == F.col("failed")) & F.expr("shiftright(prefix, f) & 1 = 1"), how)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part (source), order of the filters A to E and step of it: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley, as numbers of rows.

    A null text is empty, a null source is ''. A row with a null doc_id never fails E, makes no other
    row fail it, and has no label. Rows that repeat count each; of labels that repeat or disagree,
    any 1 counts. An empty table gives no rows; columns of other names are ignored.

    Only rows that fail some filter are followed through the sets; the rest survive all.
    """
    scratch = Scratch(spark, "filter_audit")
    rows, failing = failing_ids(spark, docs, scratch)
    failures, names = stacked(failing), list(failing)
    labels = only(labels, doc_id="long", quality="long", toxic="long").filter("doc_id IS NOT NULL")
    lost = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("good OR toxic")
    touched = rows.join(failures, F.col("row") == F.col("failed"), "left_semi").join(lost, "doc_id", "left")
    touched = scratch.table(touched.select("row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "touched")

    n = F.count(F.lit(1))
    sets = F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))
    alive = after_prefixes(touched, failures, sets, "left_anti").groupBy("part", "prefix").agg(n.alias("alive"))
    fails = touched.join(failures, F.col("row") == F.col("failed")).select("row", "part", "good", "toxic", F.col("f").alias("filter"))
    earlier = F.expr(f"filter(sequence(0, {(1 << len(names)) - 1}), p -> shiftright(p, filter) & 1 = 0)")
    removed = after_prefixes(fails, failures, earlier, "left_anti").groupBy("part", "filter", "prefix")
    removed = removed.agg(n.alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    redundant = after_prefixes(fails, failures, earlier, "left_semi").groupBy("part", "filter", "prefix").agg(n.alias("redundant"))
    parts = rows.groupBy("part").agg(n.alias("rows"))
    counts = {"parts": parts, "alive": alive, "removed": removed, "redundant": redundant}
    return by_order(names, **{name: scratch.table(t, name) for name, t in counts.items()})


def by_order(names: list[str], parts: DataFrame, alive: DataFrame, removed: DataFrame, redundant: DataFrame) -> DataFrame:
    """The counts of sets, told for every order and step of every part. These tables have at most
    ``2 ** n`` rows a part and filter, whatever the rows behind them."""
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"('{''.join(names[i] for i in order)}', {step}, {f}, {before}, {before | 1 << f})")
            before |= 1 << f
    orders = F.expr(f"inline(transform(array({', '.join(steps)}), s -> named_struct('filter_order', s.col1, 'step', s.col2, 'filter', s.col3, 'prefix', s.col4, 'after', s.col5)))")
    touched = alive.filter("prefix = 0").select("part", F.col("alive").alias("touched"))
    parts = parts.join(touched, "part", "left").select("part", (F.col("rows") - F.coalesce("touched", F.lit(0))).alias("untouched"))
    whole = (1 << len(names)) - 1
    alone = removed.filter(F.expr(f"prefix = {whole} ^ shiftleft(1, filter)")).select("part", "filter", F.col("removed").alias("unique_fails"))
    every = parts.select("part", "untouched", orders)
    every = every.join(alive.withColumnRenamed("prefix", "after"), ["part", "after"], "left").join(removed, ["part", "filter", "prefix"], "left")
    every = every.join(redundant, ["part", "filter", "prefix"], "left").join(alone, ["part", "filter"], "left")
    shapley = every.groupBy("part", "filter").agg(F.sum(F.coalesce("removed", F.lit(0))).alias("shapley"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    every = every.join(shapley, ["part", "filter"])
    told = ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return every.select("part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("untouched") + count("alive")).cast("long").alias("kept"), *[count(c).alias(c) for c in told])
