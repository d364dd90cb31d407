"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from its words, for what they say beyond a
sentence without evidence: 1 - p_s is divided by that of the bias alone, and is 1 at most. Noisy-or combines
the sentences of a passage, p = 1 - prod(1 - p_s), and a document is as toxic as its worst passage: ``SPAN``
sentences in a row, so weak evidence counts where it is dense and does not add up over a long text. A small
leak is the chance that a label is none of the sentences' doing.

That one formula is both what is scored and what is fitted: the sentence model is trained through it, leak,
passages and all, from document labels alone, and then points at the sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only, prepared
from palimpsest.llm.words import give_back, mix, slices, words

#: The model is fitted on at most so many labelled rows of each label, chosen by a hash of doc_id.
FIT_ROWS = 4000
BITS = 18
#: A feature is a candidate if it is in at least so many toxic documents, and so many times as often as in clean ones.
MIN_DOCS, LIFT = 3, 3.0
#: LASSO: a feature needs the evidence of about so many documents to get a weight.
STEPS, RATE, LASSO = 200, 0.1, 1.5
THRESHOLD, SPAN, LEAK = 0.3, 12, 1e-3
#: Longer texts (characters) are not fitted on, so what comes to the driver is bounded; they are scored like all others.
FIT_LENGTH = 200_000
EDGE = "\x1e"
PUNCTUATION = ".,;:!?|\"'()[]"


def features_of(names: pa.Array) -> np.ndarray:
    """For each word its features: the word in lower case without outer punctuation, and how it begins
    (4 and 5 characters), as many languages add to a stem."""
    bare = pc.utf8_lower(pc.utf8_trim(names, PUNCTUATION))
    forms = [(0, bare), *((k, pc.utf8_slice_codeunits(bare, 0, k)) for k in (4, 5))]
    hashes = [mix(pd.util.hash_array(np.asarray(x.to_pandas(), dtype=object), categorize=False), k) for k, x in forms]
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes], axis=1)


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a column of texts: its text, its sentence (numbered over all texts, without
    gaps) and its row in the last, which has the features. A sentence ends after a word that ends with ``.``, ``!`` or ``?``, and at a
    line's end. Null and empty texts have no sentence."""
    lines = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", f" {EDGE} ")
    offsets, flat = words(lines)
    n = len(flat)
    if not n:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, 3), np.int64))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    edge = pc.equal(names, EDGE).to_numpy(zero_copy_only=False)[codes]
    ends = pc.match_substring_regex(names, r"[.!?]$").to_numpy(zero_copy_only=False)[codes] | edge
    new = np.ones(n, bool)
    new[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    sentence, keep = np.cumsum(new), ~edge
    doc, sentence, codes = doc[keep], sentence[keep], codes[keep]
    if len(sentence):
        sentence = np.cumsum(np.diff(sentence, prepend=sentence[0] - 1) > 0) - 1
    return doc, sentence, codes, features_of(names)


def log_clean(z: np.ndarray, bias: float) -> np.ndarray:
    """The logarithms of 1 - p_s of sentences with logits ``z``, against a sentence of the bias alone."""
    return np.minimum(0, np.logaddexp(0, bias) - np.logaddexp(0, z))


def passages(clean: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the passage of ``SPAN`` sentences up to each sentence the logarithm of the chance that it is clean, from those of
    its sentences, and where it begins: not before ``first``, the first sentence of the document."""
    upto = np.concatenate([[0], np.cumsum(clean)])
    begin = np.maximum(first, np.arange(len(clean)) - SPAN + 1)
    return np.minimum(0, upto[1:] - upto[begin]), begin


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: probability, number of its most offending sentence (-1: none), its probability."""
        doc, sentence, codes, table = sentences(texts)
        clean, worst, at = np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), -1)
        if len(doc):
            z = np.bincount(sentence, self.weights[table].sum(axis=1)[codes]) + self.bias
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            of = doc[first]
            p = -np.expm1(log_clean(z, self.bias))
            np.minimum.at(clean, of, passages(log_clean(z, self.bias), np.searchsorted(of, of))[0])
            np.maximum.at(worst, of, p)
            number = np.arange(len(of)) - np.searchsorted(of, of)
            hit = np.flatnonzero(p >= worst[of])[::-1]
            at[of[hit]] = number[hit]
        return np.clip(-np.expm1(clean + np.log1p(-LEAK)), 0, 1), at, worst


def candidates(counts: list[tuple[int, float, float]], n_clean: float, n_toxic: float) -> np.ndarray:
    """The features that may get weights (see ``MIN_DOCS``), of (feature, clean, toxic documents)."""
    return np.array(sorted(f for f, clean, toxic in counts if toxic >= MIN_DOCS and toxic / max(1e-9, n_toxic) >= LIFT * clean / max(1e-9, n_clean)), np.int64)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, used: np.ndarray) -> Model:
    """Proximal gradient descent (Adam steps, soft thresholds) on the weighted log loss of the
    worst passages of bags (number of sentences, and sentence and feature of each occurrence of the ``used``
    features, which alone get weights): what ``Model.score`` computes.

    The soft thresholds choose among them in the first half of the steps; the second half fits the
    chosen ones without shrinking them.
    """
    y = labels.astype(bool)
    index = np.full(1 << BITS, -1)
    index[used] = np.arange(len(used))
    counts = np.array([n for n, _, _ in bags], np.int64)
    starts = np.cumsum(counts) - counts
    base = int(counts.sum())
    sent = np.concatenate([*(s + at for (_, s, _), at in zip(bags, starts.tolist(), strict=True)), np.zeros(0, int)]).astype(np.int64)
    feat = index[np.concatenate([*(f for _, _, f in bags), np.zeros(0, int)]).astype(np.int64)]
    doc_of = np.repeat(np.arange(len(bags)), counts)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    w, b = np.full(len(used) + 1, 2.0), -7.0  # from zero no sentence would have enough gradient to begin
    lasso = LASSO / max(1.0, weights.sum())
    weights = weights / max(1e-9, weights.sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1 if base and y.any() else 1):
        z = np.bincount(sent, w[feat], base) + b
        value, begin = passages(log_clean(z, b), starts[doc_of])
        clean = np.zeros(len(bags))
        np.minimum.at(clean, doc_of, value)
        ends = np.flatnonzero(value <= clean[doc_of])[::-1]
        last = np.full(len(bags), -1)
        last[doc_of[ends]] = ends  # where the first of the worst passages ends
        last = last[last >= 0]
        edge = np.zeros(base + 1, np.int64)
        np.add.at(edge, begin[last], 1)
        np.add.at(edge, last + 1, -1)
        counted = (np.cumsum(edge)[:-1] > 0) & (z > b)
        clean += np.log1p(-LEAK)  # log of 1 - p
        p = -np.expm1(clean)
        # d loss / d clean: negatives lose -clean, positives -log(1 - exp(clean))
        g = np.where(y, weights * (1 - p) / p, -weights)[doc_of]
        dz = np.where(counted, -g * sigmoid(z), 0)
        db = np.where(counted, g * (sigmoid(b) - sigmoid(z)), 0).sum()
        grad = np.append(np.bincount(feat, dz[sent], len(used)), db)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = scale * m / (1 - 0.9**t)
        if t <= STEPS // 2:
            w = w - step
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - lasso * scale[:-1])
        else:
            w = np.where(w != 0, w - step, 0)
        b -= float(step[-1])
    out = np.zeros(1 << BITS)
    out[used] = w[:-1]
    return Model(out, b)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from the labelled documents that are not held out.

    Fitted are at most ``rows`` documents of each label, of at most ``FIT_LENGTH`` characters; to the driver come the numbers of their sentences and
    the occurrences of features that are candidates, not their texts. Null labels and ids count as no label; of
    repeated labels the largest holds; repeated documents count as often as they occur. Without any positive row
    the model calls nothing toxic.
    """
    labels = only(labels, doc_id="long", toxic="int").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("order", F.xxhash64("doc_id", F.lit("fit")))
    total = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [labels.filter(F.col("toxic") == y).orderBy("order", "doc_id").limit(rows) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic").collect()
    spark = docs.sparkSession
    picked = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, toxic int")
    picked = Scratch(spark, "toxicity").table(only(docs, doc_id="long", text="string").filter(F.coalesce(F.length("text"), F.lit(0)) <= FIT_LENGTH).join(F.broadcast(picked), "doc_id"), "picked")
    weight = {k: n / max(1, min(n, rows)) for k, n in total.items()}

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each document, once."""
        for batch in batches:
            for b in slices(batch):
                doc, _, codes, table = sentences(b.column("text"))
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                found = [np.unique(table[codes[a:z]]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
                n = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.repeat(b.column("toxic").to_numpy(), n))], names=["feature", "toxic"])

    per = picked.mapInArrow(seen, "feature long, toxic int").groupBy("feature").agg(*(F.sum((F.col("toxic") == y).cast("double") * weight.get(y, 0.0)).alias(f"n{y}") for y in (0, 1)))
    n = {r["toxic"]: r["n"] * weight[r["toxic"]] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = candidates([tuple(r) for r in per.filter(F.col("n1") >= MIN_DOCS).collect()], n.get(0, 0.0), n.get(1, 0.0))
    mask = np.zeros(1 << BITS, bool)
    mask[used] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document the number of its sentences, and where the candidates are."""
        for batch in batches:
            for b in slices(batch):
                doc, sentence, codes, table = sentences(b.column("text"))
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                names = ["doc_id", "toxic", "n", "sentence", "feature"]
                columns: list[list] = [[], [], []]
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    f = table[codes[a:z]]
                    at, which = np.nonzero(mask[f])
                    first = sentence[a] if z > a else 0
                    columns[0].append(int(sentence[z - 1] - first) + 1 if z > a else 0)
                    columns[1].append((sentence[a:z][at] - first).astype("<i4").tobytes())
                    columns[2].append(f[at, which].astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])], names=names)

    got = picked.mapInArrow(features, "doc_id long, toxic int, n long, sentence binary, feature binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["n"], r["feature"], r["sentence"]))
    y = np.array([r["toxic"] for r in got], int)
    bags = [(r["n"], np.frombuffer(r["sentence"], "<i4"), np.frombuffer(r["feature"], "<i4")) for r in got]
    model = fit(bags, y, np.array([weight[k] for k in y.tolist()], float), used)
    del got, bags
    give_back()  # the driver lives on
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_sentence, worst_score of every row of ``docs``.

    A null or empty text has the score ``LEAK`` and worst_sentence -1. A null doc_id is not held out.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                p, at, worst = shared.value.score(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(at, pa.int32()), pa.array(worst)], names=["doc_id", "score", "worst_sentence", "worst_score"])

    out = only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, worst_sentence int, worst_score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def locate(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence_no, sentence, score of each sentence at or above ``threshold``, of every row: repeated
    rows repeat their sentences, a null doc_id stays null, texts without words have none."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                doc, sentence, codes, table = sentences(b.column("text"))
                if not len(doc):
                    continue
                p = -np.expm1(log_clean(np.bincount(sentence, shared.value.weights[table].sum(axis=1)[codes]) + shared.value.bias, shared.value.bias))
                of = doc[np.flatnonzero(np.diff(sentence, prepend=-1))]
                number = np.arange(len(of)) - np.searchsorted(of, of)
                rows: list[tuple] = []
                for i in np.unique(of[p >= threshold]).tolist():
                    _, flat = words(pc.replace_substring(b.column("text").slice(i, 1).cast(pa.large_string()), "\n", f" {EDGE} "))
                    parts, now = [], []
                    for w in flat.to_pylist():
                        if w != EDGE:
                            now.append(w)
                        if now and (w == EDGE or w[-1] in ".!?"):
                            parts.append(now)
                            now = []
                    parts += [now] * bool(now)
                    rows += [(b.column("doc_id")[i].as_py(), int(number[k]), " ".join(parts[number[k]]), float(p[k])) for k in np.flatnonzero((of == i) & (p >= threshold))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "sentence_no", "sentence", "score"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, sentence_no long, sentence string, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns. Null and empty texts
    stay, repeated rows share their fate, an empty table gives no rows."""
    prepared(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                p, _, _ = shared.value.score(b.column("text"))
                yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, schema)
