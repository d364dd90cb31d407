"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import bpe
from palimpsest.llm.common import Scratch, only


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every whole text; a null or empty text has 0."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocabulary)
        for b in batches:
            n = [sum(map(len, enc.parts(t))) if (t := x.as_py()) else 0 for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return only(docs, doc_id="long", text="string").mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs. Sums of documents for each length are
    made before the shuffle, so a length that most documents share moves as one row a task."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


BLOCK = 256


def answers(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, taken as a context limit:

    docs_longer and tokens_longer (documents of more than L tokens), docs_upto and tokens_upto (the
    rest), truncated_total (the tokens left when every document is cut at L), quantile (the share of
    documents of at most L tokens). An empty histogram gives no rows.

    Suffix sums come in two levels, over blocks of ``BLOCK`` lengths and inside a block, so that
    only block sums meet in one task.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(before), F.lit(0)).alias("p_docs"),
        F.coalesce(F.sum("b_tokens").over(before), F.lit(0)).alias("p_tokens"),
        F.sum("b_docs").over(every).alias("docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(blocks, "block")
    h = h.withColumn("docs_upto", F.col("p_docs") + F.sum("n_docs").over(within)).withColumn("tokens_upto", F.col("p_tokens") + F.sum("tokens").over(within))
    docs_longer, tokens_longer = F.col("docs") - F.col("docs_upto"), F.col("all_tokens") - F.col("tokens_upto")
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_upto",
        "tokens_upto",
        docs_longer.alias("docs_longer"),
        tokens_longer.alias("tokens_longer"),
        (F.col("tokens_upto") + docs_longer * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_upto") / F.col("docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``answers`` for all of ``docs``. The histogram is written first, so texts are encoded once."""
    histogram = length_histogram(encoded_lengths(docs, vocabulary))
    return answers(Scratch(docs.sparkSession, "lengths").table(histogram, "histogram"))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents do not exceed; None if empty."""
    row = answers(histogram).filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("at")).first()
    return row["at"]


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """The tokens left when every document is cut at any ``limit``, which need not occur."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("n")).first()["n"]
