"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut, left to right, into the longest phrases that the
language's text has (cross parsing); phrases x log2(training symbols) / symbols of the text estimates its cross entropy in
bits a symbol, and the language of the least wins.

The greedy parse over an automaton is a transducer: where a state lacks a symbol's transition, the parse starts a phrase and
takes the symbol from the root. Its table is dense, so many texts are parsed at once, one symbol of each at a step. Texts are
parsed whole: strips of STRIP symbols side by side, then mended where the state that one ends in makes a difference to the next.

Symbols: letters in lower case; all other characters are one separator, runs of it one symbol; letters that no training text
has match nothing.

Training takes a bounded sample: documents with a label that are not held out, about SAMPLE_DOCS for each language by hash, up to
TRAIN_SYMBOLS symbols a language. A text of more than SAMPLE_CHARS characters gives a passage of so many, from its first letter on.

Defined results: a null text, or one without a letter, is "und" with score 0; ties go to the first language by name; without
training text every document is "und", and accepted() then keeps all that have a letter; a null doc_id is neither learned from nor held out; repeated rows get equal answers.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fold, read_table, under_own_names
from .suffix_automaton import SuffixAutomaton

TRAIN_SYMBOLS = 20_000
SAMPLE_DOCS = 60
SAMPLE_CHARS = 20_000
STRIP = 2048
LANES = 4096
UNDETERMINED = "und"
LETTER = r"\p{L}"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]


def _letters() -> np.ndarray:
    """For each code point of a lower-cased text, whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for start in range(0, 0x110000, 0x1000):
        if not 0xD800 <= start < 0xE000:
            out[start : start + 0x1000] = [chr(c).isalpha() for c in range(start, start + 0x1000)]
    return out


def symbols_of(text: str, codes: np.ndarray) -> np.ndarray:
    """A text's symbols: 0 for a run of separators, else codes[code point]."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = codes[points]
    gap = out == 0
    return out[~(gap & np.concatenate(([True], gap[:-1])))] if len(out) else out


class Model:
    """The transducers of all languages in one table: entry [state x width + symbol] is 2 x (next state x width) + phrase started."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        letters = _letters()
        seen = sorted({c for texts in samples.values() for t in texts for c in t.lower() if letters[ord(c)]})
        # 0 separator, 1 letters unknown to all languages, then the known; a script of more than 250 letters takes 16 bits
        self.width = len(seen) + 2
        self.codes = letters.astype(np.uint8 if self.width < 256 else np.uint32)
        for i, c in enumerate(seen):
            self.codes[ord(c)] = i + 2
        self.roots, self.rates, tables, base = [], [], [], 0
        for language in self.languages:
            automaton, used = SuffixAutomaton(), 0
            for text in samples[language]:
                sequence = symbols_of(text, self.codes)[: max(0, TRAIN_SYMBOLS - used)].tolist()
                automaton.add(sequence)
                used += len(sequence)
            table = np.full((len(automaton.next), self.width), -1, np.int64)
            for state, edges in enumerate(automaton.next):
                if edges:
                    table[state, list(edges)] = list(edges.values())
            missing = table < 0
            root = np.where(table[0] < 0, 0, table[0])
            table = np.where(missing, root[None, :], table)
            missing[0] = True  # a phrase starts at the root
            tables.append((((table + base) * self.width) << 1) | missing)
            self.roots.append(base * self.width)
            self.rates.append(math.log2(max(used, 2)))
            base += len(automaton.next)
        table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        self.table = table.astype(np.int32) if base * self.width < 1 << 30 else table

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text's parse by each language.

        Strips of a text are first parsed side by side, each as if a phrase started there. Then each strip but the first is parsed again from
        where the one before it ended, until both parses meet, and the difference in phrases is added; a strip whose parses don't meet
        passes the change on to the next one."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        strips = [(len(t) - at if len(t) - at < STRIP else STRIP, i, at) for i, t in enumerate(texts) for at in range(0, len(t), STRIP)]
        strips.sort(key=lambda s: -s[0])
        ends: dict[tuple[int, int], np.ndarray] = {}
        roots = np.array(self.roots, self.table.dtype)
        for first in range(0, len(strips), LANES):
            lanes = strips[first : first + LANES]
            counts, last = self._parse(self._grid(texts, lanes), np.array([n for n, _, _ in lanes]), np.repeat(roots[:, None], len(lanes), axis=1))
            np.add.at(out, [i for _, i, _ in lanes], counts.T)
            ends.update(((i, at), last[:, lane].copy()) for lane, (_, i, at) in enumerate(lanes) if len(texts[i]) > STRIP)
        starts = {key: roots for key in ends}
        changed = [(n, i, at) for n, i, at in strips if at]
        while changed:
            later = []
            for first in range(0, len(changed), LANES):
                lanes = changed[first : first + LANES]
                old = np.stack([starts[i, at] for _, i, at in lanes], axis=1)
                new = np.stack([ends[i, at - STRIP] for _, i, at in lanes], axis=1)
                starts.update(((i, at), new[:, lane].copy()) for lane, (_, i, at) in enumerate(lanes))
                more, met, last = self._meet(self._grid(texts, lanes), np.array([n for n, _, _ in lanes]), old, new)
                np.add.at(out, [i for _, i, _ in lanes], more.T)
                for lane, (n, i, at) in enumerate(lanes):
                    if not met[:, lane].all():
                        ends[i, at] = np.where(met[:, lane], ends[i, at], last[:, lane])
                        if (i, at + STRIP) in starts:
                            later.append((min(STRIP, len(texts[i]) - at - STRIP), i, at + STRIP))
            changed = sorted(later, key=lambda s: -s[0])
        return out

    def _grid(self, texts: list[np.ndarray], lanes: list[tuple[int, int, int]]) -> np.ndarray:
        """Symbols by step and lane, for lanes (length, text, place) by falling length."""
        grid = np.zeros((len(lanes), lanes[0][0]), self.table.dtype)
        for row, (n, i, at) in enumerate(lanes):
            grid[row, :n] = texts[i][at : at + n]
        return np.ascontiguousarray(grid.T)

    def _parse(self, grid: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, last states), both by language and lane, from symbols by step and lane and the states at the start."""
        count = np.zeros_like(state)
        state = state.copy()
        live = np.searchsorted(-lengths, -np.arange(len(grid)), "left")
        value = np.empty_like(state)
        for step, n in enumerate(live.tolist()):
            s, v = state[:, :n], value[:, :n]
            s += grid[step, :n]
            np.take(self.table, s, out=v, mode="clip")
            np.right_shift(v, 1, out=s)
            v &= 1
            count[:, :n] += v
        return count, state

    def _meet(self, grid: np.ndarray, lengths: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases of the new parse over those of the old one, whether both meet, last states of the new one), by language and lane."""
        more, met, last = np.zeros(old.shape, np.int64), old == new, new.copy()
        row, lane = np.nonzero(~met)
        a, b = old[row, lane].copy(), new[row, lane].copy()
        for step in range(len(grid)):
            ended = lengths[lane] == step
            if ended.any():
                last[row[ended], lane[ended]] = b[ended]
                row, lane, a, b = row[~ended], lane[~ended], a[~ended], b[~ended]
            if not len(row):
                break
            va, vb = self.table[a + grid[step, lane]], self.table[b + grid[step, lane]]
            more[row, lane] += (vb & 1).astype(np.int64) - (va & 1)
            a, b = va >> 1, vb >> 1
            same = a == b
            if same.any():
                met[row[same], lane[same]] = True
                row, lane, a, b = row[~same], lane[~same], a[~same], b[~same]
        last[row, lane] = b
        return more, met, last

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and bits a symbol of each text."""
        symbols = [symbols_of(t or "", self.codes) for t in texts]
        languages, scores, bits = [], [], []
        phrases = self.phrases(symbols)
        for sequence, row in zip(symbols, phrases, strict=True):
            if not self.languages or not sequence.any():
                languages.append(UNDETERMINED)
                scores.append(0.0)
                bits.append(None)
                continue
            rates = row * np.array(self.rates) / len(sequence)
            best = int(np.argmin(rates))
            other = float(np.delete(rates, best).min()) if len(rates) > 1 else math.inf
            languages.append(self.languages[best])
            scores.append(1.0 if other == math.inf else other / (other + float(rates[best])))
            bits.append(float(rates[best]))
        return languages, scores, bits


def _sample(labelled: DataFrame, key: str, text: str, lang: str) -> dict[str, list[str]]:
    """About SAMPLE_DOCS texts of each language, by hash of the key. Languages are few; texts are of bounded length."""
    counts = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    wanted = [(F.col(lang) == name) & (place < int(min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 30))) for name, n in counts.items()]
    rows = labelled.filter(functools.reduce(operator.or_, wanted)).select(lang, text, place.alias("place")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["place"], r[text])):
        out.setdefault(r[lang], []).append(r[text])
    return {k: v[:SAMPLE_DOCS] for k, v in out.items()}


def learn(docs: DataFrame, learnable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from rows of `docs` for which `learnable` holds."""
    usable = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).rlike(LETTER))
    passage = F.regexp_extract(text, rf"(?s){LETTER}.{{0,{SAMPLE_CHARS - 1}}}", 0)
    bounded = F.when(F.length(text) <= SAMPLE_CHARS, F.col(text)).otherwise(passage)
    return Model(_sample(usable.select(doc_id, bounded.alias(text), lang), doc_id, text, lang))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1: the runner-up's share of both entropies) and bits (a symbol, by lang_pred)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = [predict(batch.column(text).slice(at, 2000).to_pylist()) for at in range(0, batch.num_rows, 2000)]
            return [pa.array([x for p in parts for x in p[i]], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]

        return compute

    return append_columns(docs, [text], FIELDS, make, keep)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(F.col(doc_id), 4) == 2, F.lit(False))


def _model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return learn(docs, ~held_out(doc_id) & F.col(doc_id).isNotNull(), doc_id=doc_id, text=text, lang=lang)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents of `docs` that have a language, in its columns. The model learns from `docs` itself; where it has nothing to learn
    from, those with a letter are kept."""

    def step(d: DataFrame, c: dict[str, str]) -> DataFrame:
        model = _model(d, c["doc_id"], c["text"], c["lang"])
        if not model.languages:
            return d.filter(F.col(c["text"]).rlike(LETTER))
        found = identify(d, model, text=c["text"])
        return found.filter(F.col("lang_pred") != UNDETERMINED)

    return under_own_names(docs, step)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), _model(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")
