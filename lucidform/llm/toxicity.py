"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's chance to offend is a logistic function of its known words, and 0 if it has none, so that length alone
is no evidence; a document is toxic if any sentence offends (noisy-or), so its score is 1 - prod(1 - p).  The weights are fitted to document labels through that product; the
sentence scores then say where the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, chunks, cut
from lucidform.llm.words import split_words

#: Labelled documents that the fit uses at most, about; all are used where there are fewer.
SAMPLE = 8000
#: A word is a feature if it is in this many of them, its rates under the two labels differ by this many standard
#: errors, and it is among those that tell the labels apart best.
IN_DOCUMENTS, ERRORS, FEATURES = 4, 4.0, 2048
#: Beside whole words, their openings of these lengths are features, which tell inflected and joined forms.
OPENINGS = (4, 5, 6)
#: Weight of the penalty on word weights, as a share of one document's likelihood.
PENALTY = 0.02
THRESHOLD = 0.3
#: A sentence of at least this score is reported; of a document predicted toxic the highest is in any case.
OFFENDING = 0.3
TRIMMED = ".,;:!?\"'`()[]{}<>*_~-…“”‘’«»¿¡"
SENTENCE_END = "[.!?…][\"')\\]»”’]*$"
SENTENCES = "array<struct<number: int, score: double, text: string>>"


class Sentences(NamedTuple):
    """Words of several texts by sentence: sentence s owns words[starts[s]:starts[s + 1]]; text i owns sentences
    bounds[i] to bounds[i + 1]."""

    codes: np.ndarray
    plain: pa.Array
    distinct: pa.Array
    starts: np.ndarray
    bounds: np.ndarray


class Model(NamedTuple):
    words: list[str]
    weights: np.ndarray
    bias: float


def split_sentences(texts: pa.Array) -> Sentences:
    """A sentence ends at a word with a closing mark, or at a line's end."""
    codes, distinct, bounds = split_words(pc.replace_substring(pc.fill_null(texts, ""), "\n", " . "))
    plain = pc.utf8_lower(pc.utf8_trim(distinct, characters=TRIMMED))
    ends = pc.match_substring_regex(distinct, SENTENCE_END).to_numpy(zero_copy_only=False)
    first = np.zeros(len(codes), dtype=bool)
    if len(codes):
        first[1:] = ends[codes][:-1] & (pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0)[codes][1:]
        first[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(first)
    return Sentences(codes, plain, distinct, np.append(starts, len(codes)), np.searchsorted(starts, bounds))


def features(plain: pa.Array) -> list[pa.Array]:
    """Of each word itself and its openings (null where the word is no longer), marked by a final ``|``."""
    out = [plain]
    for n in OPENINGS:
        longer = pc.greater(pc.utf8_length(plain), n)
        out.append(pc.if_else(longer, pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, n), "|", ""), pa.scalar(None, pa.string())))
    return out


def _numbers(plain: pa.Array, names: pa.Array) -> np.ndarray:
    """(features of a word, words): numbers in ``names``, or -1."""
    return np.array([pc.fill_null(pc.index_in(f, value_set=names), -1).to_numpy(zero_copy_only=False) for f in features(plain)], dtype=np.int64)


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def held_out() -> Column:
    """Never null: a null doc_id counts as empty text, which isn't held out (and has no label to learn from)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(toxic, text) of about ``limit`` labelled documents that aren't held out, chosen by a hash of doc_id.

    A document with several labels counts as toxic if one says so.  Where doc_ids repeat, so that the chosen ids have
    clearly more texts than ``limit``, about so many are chosen among these by a hash of id and text, equal ones once.
    """
    told = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isNotNull())
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, limit / max(1, told.count()))
    some = told.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs)
    rows = cut(texts.join(F.broadcast(some), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text", F.lit(8)).alias("draw")), "labelled")
    n = rows.count()
    if n > 1.25 * limit:
        rows = cut(rows.where(F.pmod("draw", F.lit(1 << 20)) < int(limit / n * (1 << 20))).dropDuplicates(["draw"]), "labelled-texts")
    return rows.select("toxic", "text")


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = split_sentences(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(toxic)), np.diff(s.starts[s.bounds]))
            for feature in features(s.plain):
                encoded = pc.dictionary_encode(feature)
                names, code = encoded.dictionary, pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[s.codes]
                if len(names):
                    pairs = np.unique((owner * len(names) + code)[code >= 0])
                    word, bad = pairs % len(names), toxic[pairs // len(names)] > 0
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(word, bad, len(names)).astype(np.int64)), pa.array(np.bincount(word, ~bad, len(names)).astype(np.int64))], names=["word", "toxic", "clean"])

    return rows.select("toxic", "text").mapInArrow(run, "word string, toxic bigint, clean bigint")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, most: int = FEATURES, steps: int = 250) -> Model:
    """Learn word weights from document labels.

    The driver gets at most ``most`` features and, for each sampled document, the numbers of its known features:
    bounded by ``limit``.  Without labels of both kinds the model scores everything 0.
    """
    rows = training_rows(docs, labels, limit)
    n = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model([], np.zeros(0), -np.inf)
    bad, good = F.col("toxic") / n[1], F.col("clean") / n[0]
    rate = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    counts = _word_counts(rows).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= IN_DOCUMENTS)
    telling = F.abs(bad - good) / F.sqrt((rate * (1 - rate) + 1e-9) * (1 / n[0] + 1 / n[1]))
    words = [r["word"] for r in counts.where(telling >= ERRORS).orderBy(telling.desc(), "word").limit(most).collect()]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(words, pa.string())
        for batch in chunks(batches, "text"):
            s = split_sentences(batch.column("text"))
            code = _numbers(s.plain, names)[:, s.codes].T.ravel()
            sentence = np.repeat(np.arange(len(s.starts) - 1), len(OPENINGS + (0,)) * np.diff(s.starts))
            ok = np.flatnonzero(code >= 0)
            at = np.searchsorted(ok, len(OPENINGS + (0,)) * s.starts[s.bounds])
            each = [(code[ok[a:b]].astype("<i4").tobytes(), (sentence[ok[a:b]] - lo).astype("<i4").tobytes()) for a, b, lo in zip(at[:-1], at[1:], s.bounds[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(np.diff(s.bounds), pa.int64()), pa.array([a for a, _ in each], pa.binary()), pa.array([b for _, b in each], pa.binary())], names=["toxic", "n", "words", "sentences"])

    got = rows.select("toxic", "text").mapInArrow(known, "toxic int, n bigint, words binary, sentences binary").collect()
    return _descend(words, got, steps)


def _descend(words: list[str], rows: list, steps: int) -> Model:
    """Adam over all rows on the likelihood of the labels under noisy-or, with a small penalty on weights."""
    number = np.array([r["n"] for r in rows])
    bounds = np.concatenate([[0], np.cumsum(number)])
    code = np.concatenate([np.frombuffer(r["words"], dtype="<i4") for r in rows])
    sentence = np.concatenate([np.frombuffer(r["sentences"], dtype="<i4") + lo for r, lo in zip(rows, bounds)]).astype(np.int64)
    toxic = np.array([r["toxic"] > 0 for r in rows])
    bad = np.repeat(toxic, number)
    told = np.bincount(sentence, minlength=bounds[-1]) > 0
    theta = np.zeros(len(words) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[code], bounds[-1])
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.clip(_sums(_soft(z) * told, bounds), 1e-6, 500)  # -log of the chance that no sentence offends
        pull = np.repeat(1 / np.expm1(total), number)
        g = np.where(bad, -pull, 1.0) * p * told / len(rows)
        grad = np.append(np.bincount(code, g[sentence], len(words)), g.sum())
        grad[:-1] += PENALTY / len(rows) * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and sentences to all columns of ``docs``.

    ``sentences`` has number, score and words of the offending sentences of documents predicted toxic, else it is
    empty.  Null, empty and blank texts have no sentence and score 0.  Result columns replace columns of the same
    names.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "sentences")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.words, pa.string())
        weights = np.append(model.weights, 0.0)
        for batch in chunks(batches, "text"):
            s = split_sentences(batch.column("text"))
            code = _numbers(s.plain, names)
            z = model.bias + _sums(weights[code].sum(0)[s.codes], s.starts)
            z[_sums((code >= 0).any(0)[s.codes], s.starts) == 0] = -np.inf
            scores = np.clip(-np.expm1(-_sums(_soft(z), s.bounds)), 0.0, 1.0)
            predicted = scores >= threshold
            found = [None] * len(scores)
            for i in range(len(scores)):
                found[i] = _offending(s, z, i) if predicted[i] else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores), pa.array(predicted.astype(np.int32)), pa.array(found, pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64()), ("text", pa.string())])))],
                names=[*kept, "score", "predicted", "sentences"],
            )

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"score double, predicted int, sentences {SENTENCES}"])
    bounded_batches(docs)
    return docs.select(*kept).mapInArrow(run, schema)


def _offending(s: Sentences, z: np.ndarray, i: int) -> list[dict]:
    lo, hi = int(s.bounds[i]), int(s.bounds[i + 1])
    p = 1 / (1 + np.exp(-np.clip(z[lo:hi], -700, 700)))
    own = sorted({*np.flatnonzero(p >= OFFENDING).tolist(), int(p.argmax())})
    return [{"number": k, "score": float(p[k]), "text": " ".join(s.distinct.take(pa.array(s.codes[s.starts[lo + k] : s.starts[lo + k + 1]])).to_pylist())} for k in own]


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents not predicted toxic, with their columns as they were."""
    names = [c if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)]  # none clashes with a result's
    kept = score(docs.toDF(*names), model, threshold).where("predicted = 0")
    return kept.select(*names).toDF(*docs.columns)
