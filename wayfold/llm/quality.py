"""Quality by voting of nearest labelled documents in a latent-semantic space.

Terms are of two kinds: pairs of neighbouring characters, folded to classes (upper and lower letters, digits, white space, each ASCII sign), with
words that repeat the word before them; and words, A-Z in lower case, hashed to WORD_TERMS terms. A document's vector holds the square roots of its term shares, of each kind by
itself, words with WORD_WEIGHT, weighted by inverse document frequency; a singular value decomposition of labelled documents gives RANK latent dimensions. Labelled vectors of unit
length are broadcast; every document takes its cosine with all of them, exactly and in blocks, and its NEIGHBOURS nearest vote
with weight similarity ** POWER.

Fitting takes a bounded sample of labelled documents, about SAMPLE of each label by hash, a passage of those longer than SAMPLE_CHARS: SAMPLE x
2 vectors of RANK floats are all that is broadcast. Votes are scaled back to the labels' own shares. Scoring reads whole texts.

Defined results: a null, empty or one-character text has no terms and scores the share of label 1; so does every document if no label
can be learned from (0 without labels); ties among neighbours go to the first by doc_id; a null doc_id is neither learned from nor held out.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, read_table, utf8
from .toxicity import held_out, sample_labelled

SAMPLE = 2000
SAMPLE_CHARS = 20_000
RANK = 48
NEIGHBOURS = 15
POWER = 8
BLOCK = 512


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[0x21:0x7F] = np.arange(5, 5 + 0x7F - 0x21)
    out[0x30:0x3A], out[0x41:0x5B], out[0x61:0x7B], out[0x80:] = 1, 2, 3, 3
    out[0x0A] = 4
    _, dense = np.unique(out, return_inverse=True)
    return dense


CLASSES = _classes()
KINDS = int(CLASSES.max()) + 1
PAIRS = KINDS * KINDS + 1
WORD_TERMS, WORD_WEIGHT = 512, 0.5
TERMS = PAIRS + WORD_TERMS
#: Letters, digits and bytes of other letters make words; lower-case letters stand for capitals.
IN_WORD = np.isin(CLASSES, CLASSES[[0x30, 0x41, 0x61]])
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += 0x20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are hashed together; a word over the end of a part counts as two.
PART = 1 << 16
POWERS = np.cumprod(np.full(PART, FACTOR, np.uint64))


def word_counts(text: np.ndarray) -> np.ndarray:
    """How often each hashed word is in a text's bytes. A word's hash is a polynomial in FACTOR of its bytes, from sums over the text."""
    out = np.zeros(WORD_TERMS, np.float32)
    for at in range(0, len(text), PART):
        part = text[at : at + PART]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], IN_WORD[part], [False]))))
        starts, ends = edges[::2], edges[1::2]
        # bytes times powers that fall along the text, so that a word's sum is its hash times the power at its end
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWER[part] * POWERS[: len(part)][::-1], dtype=np.uint64)))
        hashes = (sums[ends] - sums[starts]) * INVERSES[len(part) - ends]
        hashes ^= hashes >> np.uint64(29)
        hashes *= FACTOR
        out += np.bincount((hashes >> np.uint64(64 - 9)).astype(np.int64), minlength=WORD_TERMS)
    return out


def _inverses() -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(PART, pow(int(FACTOR), -1, 1 << 64), np.uint64))))


INVERSES = _inverses()


def term_counts(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    kinds = CLASSES[raw]
    out = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=TERMS).astype(np.float32)
    words = text.split()
    repeats = sum(map(operator.eq, words, words[1:]))
    # a repeated word counts as its bytes, the measure of the other terms
    out[PAIRS - 1] = repeats * len(text) / max(1, len(words))
    if len(raw) > 1:
        out[PAIRS:] = word_counts(raw)
    return out


def weighted(counts: np.ndarray) -> np.ndarray:
    parts = [np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1)) for part in (counts[:, :PAIRS], counts[:, PAIRS:])]
    return np.concatenate((parts[0], parts[1] * np.float32(WORD_WEIGHT)), axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class Model:
    """Term weights, latent axes, and the latent vectors and labels of the sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, share: float) -> None:
        self.share, self.labels = share, labels.astype(np.float32)
        usable = len(labels) > 0
        self.idf = np.log((1 + len(labels)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1 if usable else np.ones(TERMS, np.float32)
        matrix = weighted(counts) * self.idf
        # the right singular vectors, from the terms' Gram matrix
        _, axes = np.linalg.eigh(matrix.T @ matrix) if usable else (None, np.zeros((TERMS, RANK), np.float32))
        self.axes = axes[:, ::-1][:, :RANK].astype(np.float32)
        self.known = unit(matrix @ self.axes)
        positive = float(self.labels.mean()) if usable else 0.0
        # a label's votes count as if the sample had the labels in their own shares
        self.scale = np.where(self.labels > 0, share / max(positive, 1e-9), (1 - share) / max(1 - positive, 1e-9)).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        counts = np.stack([term_counts(t) for t in texts])
        out = np.full(len(texts), self.share)
        if not len(self.labels):
            return out
        cosines = unit(weighted(counts) * self.idf @ self.axes) @ self.known.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** POWER * self.scale[near]
        total = votes.sum(1)
        some = (counts.sum(1) > 0) & (total > 0)
        out[some] = (votes * self.labels[near]).sum(1)[some] / total[some]
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", *, learnable: Column) -> Model:
    """A model from the labels for which `learnable`, over their doc_id, holds. Terms are counted on the executors."""
    rows, share = sample_labelled(docs, labels, label, learnable, SAMPLE, SAMPLE_CHARS)

    def make():
        return lambda batch: [pa.array([term_counts(t).tobytes() for t in utf8(batch.column("text"))], pa.binary())]

    counted = append_columns(rows, ["text"], [T.StructField("counts", T.BinaryType())], make, keep=["doc_id", "label"])
    found = sorted(counted.collect(), key=lambda r: (r["doc_id"], r["label"], bytes(r["counts"])))
    counts = np.array([np.frombuffer(r["counts"], np.float32) for r in found], np.float32).reshape(-1, TERMS)
    return Model(counts, np.array([r["label"] for r in found]), share)


def add_scores(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with score (0 to 1, higher where neighbours have label 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = [shared.value.scores(utf8(batch.column(text).slice(at, BLOCK))) for at in range(0, batch.num_rows, BLOCK)]
            return [pa.array(np.concatenate(parts), pa.float64())]

        return compute

    return append_columns(docs, [text], [T.StructField("score", T.DoubleType())], make, keep)


def op6_quality_lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, read_table(spark, sf_dir, "labels"), learnable=~held_out() & F.col("doc_id").isNotNull())
    found = add_scores(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
