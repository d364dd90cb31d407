"""Secret scans: fixed patterns, and strings that look random rather than like an identifier.

Two character Markov models, of random strings and of ordinary identifiers, are counted from labelled
samples; a string is told if the logarithm of the ratio of its likelihoods exceeds ``MARGIN``. All of
it is SQL functions on whole texts: no row moves but in training, whose samples are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only

# fixed values: kinds of secrets in their order, their patterns, and what each match must be as long as
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",  # a run whose rest is shorter has no longer rest behind it
    "hex": r"[0-9a-f]{32,}",
}
#: Length of the value of an assignment.
ASSIGNED = 8

#: Characters that the models tell apart; all others are 0, as is what stands before a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1
#: Strings that are scored, if they have a digit and a letter and touch no span of a pattern.
STRING = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Odds of a million to one against a string being random, as a logarithm in thousandths.
MARGIN = round(1000 * math.log(1e6))
#: Samples: documents for each label, characters of each, words or values of each, generated strings, characters of a sample.
FIT_DOCS, FIT_TEXT, FIT_WORDS, FIT_RANDOM, FIT_CHARS = 2_000, 10_000, 300, 2_000, 200
#: Observations that a character's own share weighs in the smoothing of what follows another.
WEIGHT = 20
#: Matches whose places are summed at once: sums of blocks, then within blocks.
BLOCK = 512


def _scan(steps: Column, start: Column) -> Column:
    """The running sums of ``steps`` from ``start``, each step included."""
    begin = F.struct(F.array().cast("array<bigint>").alias("out"), start.alias("at"))
    add = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"), (acc["at"] + x).alias("at"))
    return F.aggregate(steps, begin, add, lambda acc: acc["out"])


def running_sums(steps: Column) -> Column:
    """Running sums of an array of longs. Blocks keep the work near linear: arrays of SQL cannot grow in place."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
    sums = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x)
    with_blocks = lambda all_: F.flatten(F.zip_with(all_, _scan(F.transform(all_, sums), F.lit(0).cast("bigint")), lambda b, end: _scan(b, end - sums(b))))
    return F.when(F.size(steps) > 0, F.transform(F.array(blocks), with_blocks)[0]).otherwise(F.array().cast("array<bigint>"))


def locate(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """``df`` with a column ``name`` of all leftmost matches of ``pattern`` in ``text`` as (start, end, value), by
    code points, the end exclusive. What lies between matches tells where they are."""
    df = df.withColumn("found_", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    gaps = F.when(F.size("found_") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("gaps_", gaps)
    lengths = F.transform("found_", lambda m: F.length(m).cast("bigint"))
    steps = F.zip_with(F.slice(F.transform("gaps_", lambda g: F.length(g).cast("bigint")), F.lit(1), F.size("found_")), lengths, lambda g, m: g + m)
    df = df.withColumn("ends_", running_sums(steps))
    located = F.zip_with("found_", "ends_", lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))
    return df.withColumn(name, located).drop("found_", "gaps_", "ends_")


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns: start, place of the kind, end, value) and strings (those to be scored) of every row."""
    df = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        df = locate(df, kind, PATTERNS[kind])
    df = locate(df, "strings", STRING).drop("text")
    value = lambda m: F.regexp_extract(m, PATTERNS["assign"], 2)
    df = df.withColumn("assign", F.filter(F.transform("assign", lambda m: m.withField("value", value(m["value"]))), lambda m: F.length(m["value"]) >= ASSIGNED))
    of_kind = lambda k: lambda m: F.struct(m["start"], F.lit(k).alias("kind"), m["end"], m["value"])
    as_base = [F.transform(kind, of_kind(k)) for k, kind in enumerate(KINDS)]
    df = df.select("doc_id", F.array_sort(F.concat(*as_base)).alias("base"), "strings")
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    return df.withColumn("strings", F.filter("strings", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & apart(m)))


def _identifiers(words: Column) -> Column:
    """Every three words on end as an identifier or a path, by turns of four styles, with a number."""

    def join(i: Column) -> Column:
        three = F.slice(words, i * 3 + 1, F.lit(3))
        number = (F.xxhash64(three) % 1000).cast("string")
        camel = F.array_join(F.transform(three, F.initcap), "")
        styles = [F.concat(F.array_join(three, "_"), F.lit("_v"), number), F.concat(F.array_join(three, "-"), number, F.lit("-"), number), F.concat(F.lit("/"), F.array_join(three, "/"), number), F.concat(camel, number)]
        return F.element_at(F.array(*styles), (i % 4 + 1).cast("int"))

    return F.when(F.size(words) > 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 3).cast("int") - 1), join)).otherwise(F.array().cast("array<string>"))


def _some(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most ``FIT_DOCS`` distinct values of a column of ``n`` rows, those with the smallest hashes. Only a share of the
    rows whose hashes are small enough takes part, so no task gathers more than a few times that many."""
    share = min(1.0, 4 * FIT_DOCS / max(1, n))
    h = rows.select(F.xxhash64(column).alias("h"), column).filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    return h.groupBy("h").agg(F.first(column).alias(column)).orderBy("h").limit(FIT_DOCS).select(column)


def labelled_samples(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """text, label: 1 for random strings (values of patterns, and digests in the alphabets of keys), 0 for ordinary ones
    (what else documents are made of, the same joined as in identifiers and paths, and runs of a character). Documents
    are taken by the order of a hash, at most ``FIT_DOCS`` for a label."""
    plain = F.coalesce("text", F.lit(""))
    for kind in KINDS:
        plain = F.regexp_replace(plain, PATTERNS[kind], " ")
    words = _some(only(docs, text="string").select(F.left("text", F.lit(FIT_TEXT)).alias("text")), "text", found.count())
    words = words.select(F.slice(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0)), 1, FIT_WORDS).alias("words"))
    words = words.select(F.filter("words", lambda w: ~(w.rlike(STRING) & w.rlike("[0-9]"))).alias("words"))  # what is to be told is of neither label
    words = words.select(F.explode(F.concat("words", _identifiers(F.col("words")))).alias("text"))
    runs = spark.range(FIT_RANDOM).select(F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(12)).alias("text"))
    words = words.unionByName(runs)
    words = words.withColumn("label", F.lit(0))
    with_base = found.filter(F.size("base") > 0)
    values = with_base.select(F.transform(F.slice("base", 1, FIT_WORDS), lambda b: F.left(b["value"], F.lit(FIT_CHARS))).alias("values"))
    values = _some(values, "values", with_base.count()).select(F.explode("values").alias("text"), F.lit(1).alias("label"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    key = F.base64(F.unhex(digest))
    drawn = spark.range(FIT_RANDOM).select(F.explode(F.array(digest, key, F.upper(F.regexp_replace(key, "[+/=]", "")))).alias("text"), F.lit(1).alias("label"))
    return words.unionByName(values).unionByName(drawn)


def _states(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(samples: DataFrame) -> DataFrame:
    """label, before, after, n: how often a character follows another in samples of a label."""
    codes = samples.select("label", _states(F.left("text", F.lit(FIT_CHARS))).alias("codes"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("codes")).alias("before"), F.col("codes").alias("after"))
    return codes.select("label", F.inline(pairs).alias("before", "after")).filter("after IS NOT NULL").groupBy("label", "before", "after").agg(F.count(F.lit(1)).alias("n"))


def train(samples: DataFrame) -> list[int]:
    """The log-likelihood ratio, in thousandths, of each of ``STATES`` characters behind each: ``STATES ** 2`` numbers.

    What follows a character is smoothed by what occurs at all, and that by one of each. Without samples all are 0.
    """
    spark = samples.sparkSession
    n = transitions(samples)
    each = spark.range(STATES**2).select("id", F.floor(F.col("id") / STATES).alias("before"), (F.col("id") % STATES).alias("after"))
    for label in (0, 1):
        own = n.filter(F.col("label") == label)
        one = own.groupBy("after").agg(F.sum("n").alias("of_after"))
        of_before = own.groupBy("before").agg(F.sum("n").alias("of_before"))
        each = each.join(own.select("before", "after", "n"), ["before", "after"], "left").join(one, "after", "left").join(of_before, "before", "left").fillna(0)
        whole = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        alone = (F.col("of_after") + 1) / (whole + STATES)
        each = each.withColumn(f"log{label}", F.log((F.col("n") + WEIGHT * alone) / (F.col("of_before") + WEIGHT))).drop("n", "of_after", "of_before")
    ratio = each.select("id", F.round((F.col("log1") - F.col("log0")) * 1000).cast("int").alias("ratio"))
    return [r["ratio"] for r in ratio.orderBy("id").collect()]  # STATES ** 2 rows, whatever the samples


def log_ratio(text: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of a string, in thousandths: above 0 if it is likelier random."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda acc, c: F.struct(c.alias("at"), (acc["sum"] + F.element_at(table, acc["at"] * STATES + c + 1)).alias("sum"))
    return F.aggregate(_states(text), begin, step, lambda acc: acc["sum"])


def scan(spark: SparkSession, docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """For every row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` by code points, by start and then by kind, joined by commas. Kind
    ``random`` holds the strings that the models tell; none touches a span of a pattern. ``model``
    is that of ``train``; without one it is trained on ``docs``. A null text is empty and has no
    spans; rows that repeat are scanned each; an empty table gives no rows; columns of other names
    are ignored.
    """
    found = Scratch(spark, "secret_scan").table(found_spans(docs), "found")
    model = model or train(labelled_samples(spark, docs, found))
    kinds = F.array(*map(F.lit, (*KINDS, "random")))
    more = F.filter("strings", lambda m: log_ratio(m["value"], model) > MARGIN)
    more = F.transform(more, lambda m: F.struct(m["start"], F.lit(len(KINDS)).alias("kind"), m["end"]))
    base = F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"]))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.array_sort(F.concat(base, more))).alias("spans"),
    )
