"""Benchmark decontamination: training words run through a suffix automaton of the benchmark's items.

Texts are normalised to words (A-Z in lower case; WORD). The automaton gives, at each word, the longest match with any
item; a match of `window` words or more is an occurrence of a window, as is a whole item shorter than that. Words outside the
items' vocabulary reset the automaton, so only runs of vocabulary words that can hold a window are walked.

Defined results: a null or wordless text has no words, no hits and coverage 0; a null or wordless item never occurs; repeated
items with one id count once; an item with a null id marks words and counts as item "null"; repeated documents are each
answered; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, landed, read_table, utf8
from .suffix_automaton import SuffixAutomaton

#: A word, on UTF-8 bytes: the class has all of ASCII but digits and lower-case letters, so bytes from 0x80 are word bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Items go into automata of about so many characters (150 MB in a worker); a larger benchmark takes several passes.
BLOCK_CHARS = 1_500_000

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


class Items:
    """The automaton of a block of benchmark items and, for its windows, the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.vocabulary, self.automaton = window, {}, SuffixAutomaton()
        self.least = window
        self.holders: dict[int, set[str]] = {}  # by the state that has a window's words
        self.whole: dict[int, dict[int, set[str]]] = {}  # state -> length -> short items
        words = [(key, self._ids(text)) for key, text in items]
        words = [(key, ids) for key, ids in words if ids]
        ends = [self.automaton.add(ids) for _, ids in words]
        a = self.automaton
        for (key, ids), end in zip(words, ends, strict=True):
            if len(ids) < window:
                self.least = min(self.least, len(ids))
                self.whole.setdefault(self._state_of(end, len(ids)), {}).setdefault(len(ids), set()).add(key)
                continue
            state = matched = 0
            for symbol in ids:
                state, matched = a.step(state, matched, symbol)
                if matched >= window:
                    self.holders.setdefault(self._state_of(state, window), set()).add(key)

    def _ids(self, text: bytes) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(text.lower())]

    def _state_of(self, state: int, length: int) -> int:
        """The state that has the last `length` symbols of a match in `state`."""
        link, lengths = self.automaton.link, self.automaton.length
        while lengths[link[state]] >= length:
            state = link[state]
        return state

    def matches(self, run: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of the run's words in windows, as found, and the items that have those."""
        spans, found, state, matched = [], set(), 0, 0
        for end, symbol in enumerate(run, 1):
            state, matched = self.automaton.step(state, matched, symbol)
            if matched >= self.window:
                spans.append((end - self.window, end))
                found |= self.holders[self._state_of(state, self.window)]
            if self.whole:
                at = state
                while at > 0:
                    for length, keys in self.whole.get(at, {}).items():
                        if length <= matched:
                            spans.append((end - length, end))
                            found |= keys
                    at = self.automaton.link[at]
        return spans, found

    def search(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which of them are hit (None: none), and the items found."""
        words = WORD.findall(text.lower())
        n = len(words)
        if n < self.least:
            return n, None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        hit, found = None, set()
        for i in np.flatnonzero(ends - starts >= self.least):
            s = int(starts[i])
            spans, keys = self.matches(ids[s : ends[i]].tolist())
            found |= keys
            for a, b in spans:
                if hit is None:
                    hit = np.zeros(n, bool)
                hit[s + a : s + b] = True
        return n, hit, found


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The items in parts of BLOCK_CHARS or so, each of which the driver can hold."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // BLOCK_CHARS)
    return [items] if parts == 1 else [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i) for i in range(parts)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None
) -> DataFrame:
    """`docs` with n_words, n_hit, hit_spans (starts and ends of runs of hit words, in turn), hit_items (ids as text), one row for each row.

    The benchmark is broadcast in blocks of checked size; beyond one block, each takes a pass over the documents.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_id, item_text)
    out, before = docs, False
    for i, block in enumerate(blocks or [None]):
        rows = [] if block is None else [(r["item"], r["text"].encode()) for r in block.collect()]
        items = spark.sparkContext.broadcast(Items(rows, window))
        names = None if keep is None else list(keep)
        if before or i + 1 < len(blocks):
            names = None  # later passes need the text
        out = _pass(out, items, text, before, names)
        if i + 1 < len(blocks):
            out, before = landed(out, "contamination"), True
    return out if keep is None else out.select(*keep, *(f.name for f in FIELDS))


def _pass(docs: DataFrame, items, text: str, before: bool, keep: list[str] | None) -> DataFrame:
    def make():
        search = items.value.search

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            earlier = zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True) if before else repeat(((), ()))
            words, hits, spans, keys = [], [], [], []
            for body, (old_spans, old_keys) in zip(utf8(batch.column(text)), earlier, strict=False):
                n, hit, found = search(body)
                if old_spans:
                    hit = np.zeros(n, bool) if hit is None else hit
                    for a, b in zip(old_spans[::2], old_spans[1::2], strict=True):
                        hit[a:b] = True
                words.append(n)
                hits.append(0 if hit is None else int(hit.sum()))
                spans.append([] if hit is None else np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist())
                keys.append(sorted(found.union(old_keys)))
            return [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.string()))]

        return compute

    needs = [text, "hit_spans", "hit_items"] if before else [text]
    return append_columns(docs, needs, FIELDS, make, keep)


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.0
) -> DataFrame:
    """The documents without benchmark passages, in the columns of `docs`.

    A document of which more than `max_coverage` of the words are hit goes; from the others the hit spans are cut, from the
    first byte of the first word to the last of the last, leaving a line break. At 0 every hit document goes.
    """
    columns = docs.columns
    found = find_contamination(docs, benchmark, text=text, item_id=item_id, item_text=item_text, window=window)
    kept = found.filter(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))
    if max_coverage <= 0:
        return kept.select(*columns)

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for body, spans in zip(batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist(), strict=True):
                if spans:
                    raw = body.encode()
                    at = [m.span() for m in WORD.finditer(raw.lower())]
                    cuts = [(at[a][0], at[b - 1][1]) for a, b in zip(spans[::2], spans[1::2], strict=True)]
                    ends = [0, *(b for _, b in cuts)]
                    starts = [*(a for a, _ in cuts), len(raw)]
                    body = b"\n".join(raw[a:b] for a, b in zip(ends, starts, strict=True)).decode()
                out.append(body)
            return [pa.array(out, pa.string())]

        return compute

    return append_columns(kept, [text, "hit_spans"], [T.StructField(text, T.StringType())], make).select(*columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), k AS (
  SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM k)
), p AS (
  SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM k) AS sizes WHERE len(w) >= n
), m AS (
  SELECT p.doc_id, p.i, p.n, g.item FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, CAST(n AS BIGINT))) AS j FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
