"""Toxicity by compression distance between zstandard dictionaries.

Two dictionaries are trained on labelled text: one on ordinary documents, one on what marks toxic documents, the words with a
run of GRAMS bytes that is found in at least SUPPORT of the contexts of toxic documents and RATIO times as often there as in
ordinary ones.
The toxic side compresses with its dictionary before the ordinary one's content, so ordinary words compress alike on both sides and
the difference in length of a window is what the toxic dictionary saves.

A window is a word between FRAME, which is long enough for the compressor to try and ends both dictionaries, and TAIL, which
neither has; both cost the same everywhere; larger windows drown one marked word in the noise of a dozen others. A window is a hit if it saves at least a margin
of bytes. The margin and the rates of hits in toxic and ordinary text are calibrated on labelled documents that trained no
dictionary: of all margins, that with the largest divergence of the two rates. The score is the posterior of a document's count
of hits among its windows under two Poisson rates.

Fitting takes a bounded sample of labelled documents: about SAMPLE of each label by hash; a text of more than SAMPLE_CHARS
characters gives a passage of PASSAGE_CHARS.
Scoring reads whole texts.

Defined results: a null or empty text has no window and scores the share of toxic documents among the labelled; with labels of one kind or
none every document scores that share (0 if none); a null doc_id is neither learned from nor held out; of several labels of one
document each counts; a null label doesn't.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fold, read_table, utf8

SAMPLE = 2000
SAMPLE_CHARS, PASSAGE_CHARS = 20_000, 2000
GRAMS, SUPPORT, RATIO = (5, 7, 9), 1e-4, 6.0
DICTIONARY, MARKS = 16_384, 2048
MIN_MATCH = 4
MARGINS = range(1, 9)
FRAME = b"\n\x01\x02\x03\x04\x05\x06\x07\x08\x09\x0a\x0b\x0c\x0d\x0e"
#: The compressor looks for no match in the last bytes of its input.
TAIL = bytes(range(0xC8, 0xD4))
#: Words whose windows a worker remembers.
CACHE = 500_000
#: A run of letters, on UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
class Compressor:
    """Lengths of windows when compressed with a dictionary."""

    def __init__(self, content: bytes) -> None:
        # a match is taken wherever there is one: pricing by symbol statistics misjudges such short inputs
        parameters = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=MIN_MATCH, hash_log=15, chain_log=15, search_log=7, window_log=16,
            write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
        if dictionary is not None:
            dictionary.precompute_compress(compression_params=parameters)
        self.compressor = zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)

    def lengths(self, words: list[bytes]) -> list[int]:
        compress = self.compressor.compress
        return [len(compress(FRAME + b" " + w + b" " + TAIL)) for w in words]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary of `size` bytes trained on samples; too few to train on are put together, the most frequent last."""
    if sum(map(len, samples)) >= 8 * size:
        try:
            raw = zstandard.train_dictionary(size + 512, samples, k=64, d=6).as_bytes()
            return raw[-size:]  # without the entropy tables at its head
        except zstandard.ZstdError:
            pass  # the trainer found nothing that repeats
    return b"".join(s for s, _ in reversed(Counter(samples).most_common(size // 4)))[-size:]


def marked_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The words of toxic documents that mark them, as often as they occur."""

    def contexts(texts: list[bytes]) -> Counter:
        """In how many different contexts, after different words, each word occurs; copies of a text add none."""
        pairs = set()
        for text in texts:
            words = WORD.findall(text)
            pairs.update(zip([b"", *words], words, strict=False))
        return Counter(w for _, w in pairs)

    def runs(word: bytes) -> set[bytes]:
        word = b" " + word + b" "
        return {word[i : i + k] for k in GRAMS for i in range(len(word) - k + 1)}

    def grams(words: Counter) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            for g in runs(w):
                out[g] += n
        return out

    words_here, words_there = contexts(toxic), contexts(ordinary)
    here, there = grams(words_here), grams(words_there)
    share = words_here.total() / max(1, words_there.total())
    least = max(3.0, SUPPORT * words_here.total())
    marks = {g for g, n in here.items() if n >= least and n >= RATIO * (there[g] + 1) * share}
    marked = {w for w, n in words_here.items() if n > 1 and not marks.isdisjoint(runs(w))}
    return [b" " + w + b" " for text in toxic for w in WORD.findall(text) if w in marked]


class Model:
    """Dictionaries, the margin in bytes that makes a hit, hit rates of toxic and ordinary windows, and the share of toxic documents."""

    def __init__(self, labelled: list[tuple[bytes, int]], share: float) -> None:
        self.share, self.margin, self.rates = share, 0, None
        self.ordinary = self.toxic = b""
        sides = {kind: [t.lower() for t, k in labelled if k == kind] for kind in (0, 1)}
        if not sides[0] or not sides[1]:
            return
        fit = {k: [t for i, t in enumerate(v) if i % 3 or len(v) < 3] for k, v in sides.items()}
        held = {k: v[::3] for k, v in sides.items()}
        self.ordinary = trained([b" ".join(words[i : i + 8]) for text in fit[0] for words in [WORD.findall(text)] for i in range(0, len(words), 8)], DICTIONARY)
        marks = marked_words(fit[1], fit[0])
        self.toxic = trained(marks, MARKS) if marks else b""
        saved = {kind: Counter(s for t in texts for s in self._saved(WORD.findall(t))) for kind, texts in held.items()}
        best = -1.0
        for margin in MARGINS:
            low, high = ((sum(n for s, n in saved[k].items() if s >= margin) + 0.5) / (saved[k].total() + 1.0) for k in (0, 1))
            gain = high * math.log(high / low) - (high - low)
            if high > low and gain > best:
                best, self.margin, self.rates = gain, margin, (low, high)

    def _compressors(self) -> tuple[Compressor, Compressor]:
        if "_pair" not in self.__dict__:
            self._pair = Compressor(self.ordinary + FRAME), Compressor(self.ordinary + self.toxic + FRAME)
        return self._pair

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_pair", "_known")}

    def _saved(self, words: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves in the window of each word."""
        known = self.__dict__.setdefault("_known", {})
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            plain, toxic = self._compressors()
            known.update(zip(new, map(operator.sub, plain.lengths(new), toxic.lengths(new)), strict=True))
            return list(map(known.__getitem__, words))

    def score(self, text: bytes) -> float:
        if self.rates is None or not 0 < self.share < 1:
            return self.share
        saved = self._saved(WORD.findall(text.lower()))
        low, high = self.rates
        hits = sum(map(self.margin.__le__, saved))
        log_odds = hits * math.log(high / low) - len(saved) * (high - low) + math.log(self.share / (1 - self.share))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, log_odds))))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, size: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of about `size` documents of each label, by hash, a passage of those longer than `chars`, and the share of label 1 among the learnable labels."""
    usable = labels.filter(learnable & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("label") == 1, F.lit(int(min(1.0, size / max(1, counts.get(1, 0))) * (1 << 30)))).otherwise(F.lit(int(min(1.0, size / max(1, counts.get(0, 0))) * (1 << 30))))
    chosen = usable.filter(place < limit)  # 2 x size rows or so: a bounded broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # a longer text gives a short passage, that begins where its hash says: it can't outweigh the others
    start = 1 + F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - PASSAGE_CHARS + 1, F.lit(1)))
    bounded = F.when(F.length("text") <= chars, F.col("text")).otherwise(F.substring("text", start.cast("int"), F.lit(min(PASSAGE_CHARS, chars))))
    return texts.select("doc_id", bounded.alias("text"), "label"), counts.get(1, 0) / max(1, sum(counts.values()))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, learnable: Column) -> Model:
    """A model from the labels for which `learnable`, over their doc_id, holds."""
    rows, share = sample_labelled(docs, labels, label, learnable)
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"], r["label"]))
    return Model([(r["text"].encode(), r["label"]) for r in found], share)


def add_scores(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.score
        return lambda batch: [pa.array([score(t) for t in utf8(batch.column(text))], pa.float64())]

    return append_columns(docs, [text], [T.StructField("score", T.DoubleType())], make, keep)


def held_out() -> Column:
    return F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))


def op9_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, read_table(spark, sf_dir, "labels"), learnable=~held_out() & F.col("doc_id").isNotNull())
    found = add_scores(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
