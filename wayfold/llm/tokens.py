"""Token-ID output: documents as ids, packed by Re-Pair grammars into binary shards with random access.

Documents are range-partitioned and sorted by doc_id; each partition writes one shard file. A shard is one block with one grammar; only
a shard with more than BLOCK ids, that of a very long text, has more. Re-Pair replaces frequent pairs of neighbouring symbols by new
ones (nonterminals) again and again, until no pair occurs LEAST times; a round replaces many pairs, those whose occurrences can't overlap.
Pairs don't touch an end id. The block holds rules, the length that each rule expands to, and for each document its
number of symbols and ids, so that any range of ids is decoded without the rest.

Block layout, little-endian: magic "RPG1"; header (HEADER: bytes of the block, shard, ids of the shard before the block,
documents, rules, symbols, bytes a symbol (2 or 3), vocabulary size, end id); doc_ids int64; flags uint8 (bit 0: doc_id is null, bit 1: the document goes on in
the next block); ids a document uint32; symbols a document uint32; rules uint32 pairs; expansion lengths uint32; symbols.

Files are written by Spark's text writer, block for line, so they are committed as any Spark output and go to any file
system; readers use the declared lengths. Defined results: a null text is an empty one and gives its end id alone; null doc_ids
come first; repeated rows are written each; the order of equal doc_ids is by a hash of the text; special tokens in texts are encoded as the library does; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import threading
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import landed, read_table, release_memory, work_path

END = 2
BLOCK = 1 << 21
#: Occurrences that a rule has at least: its 12 bytes in the block are then earned, at three bytes a symbol.
LEAST = 5
#: A round takes pairs at least one SHARE-th as frequent as the most frequent one.
SHARE = 512
#: Times that symbols choose their side in a round.
SIDES = 4
#: Bits of a symbol and of a place in a block: both symbols of a pair and its place fit one 64-bit number.
SYMBOL_BITS, PLACE_BITS = 20, 24
#: Ids of rules that are written out in full to decode.
SHORT = 32
#: Text bytes in a shard, for tasks with a gigabyte; more memory allows larger shards and blocks.
SHARD_BYTES = 8 << 20
MAGIC = b"RPG1"
HEADER = struct.Struct("<qqqqqqqqq")
#: Texts of these characters alone are cut into pieces here, by the pattern of byte-level BPE; others by the library. In PLAIN
#: all of LETTERS are letters to Unicode, all of NUMBERS numbers, and SPACES the only white space.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r" \t\n\r"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞]*")
PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Put before the first unit of a text, which has no space before it.
FIRST = "\x00"
#: The space in the names of byte-level BPE's ids.
SPACE = "Ġ"
#: Marks that no plain text has: before each unit, and between pieces.
MARK, SEPARATOR = "\x01", "\x02"
MARKED_PIECE = re.compile(MARK + "|" + PIECE.pattern.replace(rf"[^{SPACES}{LETTERS}{NUMBERS}]", rf"[^{MARK}{SPACES}{LETTERS}{NUMBERS}]").replace(rf"(?![^{SPACES}])", rf"(?![^{MARK}{SPACES}])"))
GAP = re.compile(rf"[{SPACES}][{SPACES}]")
#: Most units are a word and what stands after it.
WORD = rf"^(?P<word>[{LETTERS}]+)(?P<rest>[^{SPACES}{LETTERS}{NUMBERS}]*)$"
#: Entries of a worker's memory, about 200 bytes each.
PIECES = 800_000
LONG = 1 << 20
#: Texts that are encoded together.
SOME = 4096
#: Pieces that the library is given as one text.
TOGETHER = 512


def _as_list(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def has_gap(text: str) -> bool:
    """Whether white space stands beside white space in a plain text."""
    if "\t" in text or "\r" in text:
        return GAP.search(text) is not None
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `ids` (start and size each) numbered `at`, one after the other, and where each ends."""
    n = sizes[at]
    ends = np.cumsum(n, dtype=np.int32 if int(n.sum(dtype=np.int64)) < 1 << 31 else np.int64)
    places = np.repeat(starts[at].astype(ends.dtype) - ends + n, n)
    places += np.arange(len(places), dtype=ends.dtype)
    return ids[places], ends


class Memory:
    """The ids of recent pieces, one after the other in an array. When it is full, all are forgotten."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        # what has no ids has number 0
        self.numbers, self.ids, self.ends = {"": 0, MARK: 0}, np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)

    def of(self, pieces: list[str], work_out: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of pieces; `work_out` gives new ones in an order of its own, all their ids and how many each has."""
        if len(self.numbers) > self.most:
            self.forget()
        found = list(map(self.numbers.get, pieces))
        absent = [i for i, n in enumerate(found) if n is None]
        if absent:
            known, ids, sizes = work_out(list(dict.fromkeys(map(pieces.__getitem__, absent))))
            n = len(self.numbers) - 1  # numbers in use but 0, which two have
            end = int(self.ends[n - 1])
            if end + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[:end], np.zeros(end + 2 * len(ids), "<u4")])
            if n + len(sizes) > len(self.ends):
                self.ends = np.concatenate([self.ends[:n], np.zeros(n + 2 * len(sizes), np.int64)])
            self.ids[end : end + len(ids)] = ids
            self.ends[n : n + len(sizes)] = end + np.cumsum(sizes)
            self.numbers.update(zip(known, range(n, n + len(known)), strict=True))
            for i in absent:
                found[i] = self.numbers[pieces[i]]
        return np.array(found, np.int64)

    def placed(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered pieces, one after the other, and where each ends."""
        starts = self.ends[np.maximum(numbers - 1, 0)]
        return _gathered(self.ids, starts, self.ends[numbers] - starts, slice(None))


class Encoder:
    """A byte-level BPE tokenizer of the tokenizers library, with the ids of what recurs kept.

    Byte-level BPE encodes each piece of a text by itself. Where white space is single, a text falls into units at its spaces,
    and a unit with its space before it into pieces, whatever stands around it. New pieces, and texts with unusual characters
    or special tokens, go to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.vocabulary, bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == SPACE]] = True
        self.pieces = Memory(PIECES)

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [array("I", code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """A plain text's pieces in some order, all their ids, and how many each has. Pieces of a space and what isn't one are given to the library as one
        text, which cuts it into these pieces again; each has one id that begins with a space, its first."""
        order, spaced, others = [], [], []
        for piece in pieces:
            (spaced if piece[0] == " " and piece[1:2].strip() else others).append(piece)
        ids, sizes = [], []
        groups = [spaced[at : at + TOGETHER] for at in range(0, len(spaced), TOGETHER)]
        for group, raw in zip(groups, self._library(["".join(g) for g in groups]), strict=True):
            codes = np.frombuffer(raw, "<u4")
            first = np.flatnonzero(self.spaced[codes])
            if len(first) == len(group):
                order += group
                ids.append(codes)
                sizes.append(np.diff(first, append=len(codes)))
            else:
                others += group
        raws = self._library(others)
        ids.append(np.frombuffer(b"".join(raws), "<u4"))
        sizes.append(np.fromiter(map(len, raws), np.int64, len(raws)) // 4)
        return order + others, np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        ids, ends = self.pieces.placed(self.pieces.of(list(chain.from_iterable(lists)), self._of_pieces))
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *map(len, lists)])]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _by_unit(self, texts: list[str]) -> list[bytes]:
        """Texts of single white space. Each different unit is cut once, each different piece of those is looked up once, and
        ids are put together for units and then for texts."""
        split = pc.split_pattern(pa.array([FIRST + t for t in texts], pa.string()), " ")
        units = split.flatten().dictionary_encode()
        # first the units that are a word, then those with something after it, then the others
        bare = pc.utf8_is_alpha(units.dictionary)
        more = units.dictionary.filter(pc.invert(bare))
        words = pc.extract_regex(more, WORD)
        ended, others = words.drop_null(), more.filter(words.is_null())
        heads = pa.concat_arrays([units.dictionary.filter(bare), ended.field("word")]).dictionary_encode()
        rests = ended.field("rest").dictionary_encode()
        # the pieces of other units follow a mark; units but the first of a text have a space before them
        marked = (MARK + " " + pc.binary_join(_as_list(others), MARK + " ")[0].as_py()).replace(MARK + " " + FIRST, MARK) if len(others) else ""
        pieces = pc.split_pattern(pa.scalar(SEPARATOR.join(MARKED_PIECE.findall(marked))), SEPARATOR).values.dictionary_encode()
        names = [_strings(pc.binary_join_element_wise("", heads.dictionary, " ")), _strings(rests.dictionary), _strings(pieces.dictionary)]
        numbers = np.split(self.pieces.of(list(chain.from_iterable(names)), self._of_pieces), np.cumsum([len(n) for n in names[:2]]))
        of_heads, of_rests, of_pieces = (n[x.indices.to_numpy()] for n, x in zip(numbers, (heads, rests, pieces), strict=True))
        n = len(heads) - len(rests)
        ids, ends = self.pieces.placed(np.concatenate([of_heads[:n], np.stack([of_heads[n:], of_rests], axis=1).ravel(), of_pieces]))
        marks, m = np.flatnonzero(of_pieces == 0)[: len(others)], n + 2 * len(rests)
        bounds = np.concatenate(([0], ends))[np.concatenate([np.arange(n), np.arange(n, m, 2), m + marks, [m + len(of_pieces)]])]
        flags, absent = (v.to_numpy(zero_copy_only=False) for v in (bare, words.is_null()))
        run = np.empty(len(flags), np.int64)
        run[np.concatenate([np.flatnonzero(flags), np.flatnonzero(~flags)[np.argsort(absent, kind="stable")]])] = np.arange(len(flags))
        ids, ends = _gathered(ids, bounds[:-1], np.diff(bounds), run[units.indices.to_numpy()])
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text its ids, as bytes of unsigned 32-bit numbers, in one or more parts."""
        whole: dict[int, bytes] = {}
        by_unit, by_piece = [], []
        for i, text in enumerate(texts):
            if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
                whole[i] = self._library([text])[0]
            elif len(text) <= LONG:
                (by_piece if has_gap(text) else by_unit).append(i)
        whole.update(zip(by_piece, self._joined([PIECE.findall(texts[i]) for i in by_piece]), strict=True))
        if by_unit:
            whole.update(zip(by_unit, self._by_unit([texts[i] for i in by_unit]), strict=True))
        for i, text in enumerate(texts):
            yield iter([whole[i]]) if i in whole else self._by_parts(text)

    def _by_parts(self, text: str) -> Iterator[bytes]:
        found = PIECE.finditer(text)
        while part := [m.group() for m in islice(found, 200_000)]:
            yield from self._joined([part])


_ENCODERS: dict[str, Encoder] = {}
_RELEASES: dict[str, threading.Timer] = {}
#: Seconds for which a Python worker keeps an encoder after a task, so that the next task finds it; later the memory is given up.
KEEP = 3.0


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker, which its tasks share."""
    if path in _RELEASES:
        _RELEASES.pop(path).cancel()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release_later(path: str) -> None:
    def release() -> None:
        _ENCODERS.pop(path, None)
        release_memory()

    timer = _RELEASES[path] = threading.Timer(KEEP, release)
    timer.daemon = True
    timer.start()


def pack(ids: np.ndarray, lengths: np.ndarray, vocabulary: int, end: int = END, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, symbols of each document, rules) for documents of the given lengths, one after the other.

    A round sorts the pairs that can be frequent, each with its place, and so counts them exactly. Of those that occur `least` times or more
    (a pair of equal symbols counts half its places: they may overlap), it replaces all that are at least a SHARE of the most frequent one
    and can't overlap each other: a symbol is a left one, a right one or, of a pair of equal symbols, both. What waits is counted again,
    with the pairs about new symbols, until no pair is frequent enough.
    """
    if vocabulary > 1 << SYMBOL_BITS or len(ids) > 1 << PLACE_BITS:
        raise ValueError("a block takes symbols of 20 bits and 2^24 ids")
    seq, ends, rules, top = ids.astype(np.uint32), np.cumsum(lengths), [], vocabulary
    inner = seq != end
    at = np.flatnonzero(inner[:-1] & inner[1:]).astype(np.uint32)
    left, right = seq[at], seq[at + np.uint32(1)]
    while len(at) >= least and top < 1 << SYMBOL_BITS:
        packed = left.astype(np.uint64)
        packed <<= np.uint64(SYMBOL_BITS)
        packed |= right
        packed <<= np.uint64(PLACE_BITS)
        packed |= at
        packed.sort()
        at = packed.astype(np.uint32)
        at &= np.uint32((1 << PLACE_BITS) - 1)
        packed >>= np.uint64(PLACE_BITS)
        first = np.flatnonzero(packed[1:] != packed[:-1])
        first += 1
        first = np.concatenate(([0], first))
        counts = np.diff(first, append=len(at))
        often = counts >= least
        at, first, counts = at[np.repeat(often, counts)], first[often], counts[often]
        pair = packed[first].astype(np.int64)
        a, b = pair >> SYMBOL_BITS, pair & (1 << SYMBOL_BITS) - 1
        worth = np.where(a == b, (counts + 1) // 2, counts)
        frequent = worth >= least
        if not frequent.any():
            break
        chosen = _apart(a, b, worth, frequent & (worth * SHARE >= worth.max()), top)
        chosen[np.flatnonzero(chosen)[(1 << SYMBOL_BITS) - top :]] = False
        taken = np.repeat(chosen, counts)
        hit, rule, waiting = at[taken], np.repeat(np.arange(top, top + chosen.sum(), dtype=np.uint32), counts[chosen]), at[~taken]
        if (a[chosen] == b[chosen]).any():
            # of places that follow each other, in a run of equal symbols, every other one
            starts = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (rule[1:] != rule[:-1]))))
            alternate = (np.arange(len(hit)) - np.repeat(starts, np.diff(starts, append=len(hit)))) % 2 == 0
            waiting = np.concatenate([waiting, hit[~alternate]])
            hit, rule = hit[alternate], rule[alternate]
        seq[hit] = rule
        stay = np.ones(len(seq), bool)
        stay[hit + np.uint32(1)] = False
        again = np.zeros(len(seq) + 1, bool)
        again[waiting] = again[hit] = True
        # the pair before a new symbol starts at the symbol that stays before it
        before = hit.astype(np.int64) - 1
        before[~stay[before]] -= 1
        again[before] = True
        stay = np.flatnonzero(stay)
        ends = np.searchsorted(stay, ends)
        seq, again = seq.take(stay), again.take(stay)
        again[-1] = False
        at = np.flatnonzero(again).astype(np.uint32)
        left, right = seq.take(at), seq.take(at + np.uint32(1))
        inner = (left != end) & (right != end)
        at, left, right = at[inner], left[inner], right[inner]
        rules.append(np.stack([a[chosen], b[chosen]], axis=1))
        top += int(chosen.sum())
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2))
    return seq, np.diff(ends, prepend=0), all_rules.astype(np.uint32)


def _apart(a: np.ndarray, b: np.ndarray, worth: np.ndarray, among: np.ndarray, top: int) -> np.ndarray:
    """Which of the pairs (a, b) `among` all to replace together. A symbol takes the side on which more of its places are, by chance where
    there are about as many on both (along a repeated passage); symbols that this leaves without a pair choose again, a few times."""
    at = np.flatnonzero(among)
    left, right, weight = a[at], b[at], worth[at]
    side = np.zeros(top, np.int8)  # 0 open, 1 left, 2 right, 3 both
    alike = left == right
    if alike.any():
        others = np.bincount(left[~alike], weight[~alike], top) + np.bincount(right[~alike], weight[~alike], top)
        alone = alike & (2 * weight >= others[left])
        side[left[alone]] = 3
        out = [at[alone]]
        keep = ~alike & (side[left] == 0) & (side[right] == 0)
        at, left, right, weight = at[keep], left[keep], right[keep], weight[keep]
    else:
        out = []
    draws = np.random.default_rng(top)
    for _ in range(SIDES):
        if not len(at):
            break
        more = np.bincount(left, weight, top) * draws.uniform(0.5, 2.0, top) > np.bincount(right, weight, top)
        chosen = np.where(side[left] == 0, more[left], side[left] == 1) & np.where(side[right] == 0, ~more[right], side[right] == 2)
        out.append(at[chosen])
        side[left[chosen]], side[right[chosen]] = 1, 2
        keep = ~chosen & (side[left] != 2) & (side[right] != 1)
        at, left, right, weight = at[keep], left[keep], right[keep], weight[keep]
    found = np.zeros(len(a), bool)
    found[np.concatenate(out)] = True
    if not found.any():
        places = np.flatnonzero(among)
        found[places[np.argmax(worth[places])]] = True
    return found


def levels(rules: np.ndarray, vocabulary: int) -> Iterator[tuple[int, int]]:
    """Runs of rules, in order, whose parts are ids or of earlier runs."""
    latest, start = rules.max(1).astype(np.int64) - vocabulary if len(rules) else np.zeros(0, np.int64), 0
    while start < len(rules):
        later = np.flatnonzero(latest[start:] >= start)
        stop = start + int(later[0]) if len(later) else len(rules)
        yield start, stop
        start = stop


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule stands for; a rule's parts are ids or earlier rules."""
    out = np.ones(vocabulary + len(rules), np.int64)
    for start, stop in levels(rules, vocabulary):
        out[vocabulary + start : vocabulary + stop] = out[rules[start:stop]].sum(1)
    return out[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids of symbols. Rules of more than SHORT ids are cut to their parts until none is left; the others are written out once, each from
    its parts, and put wherever they stand."""
    lengths = expansion_lengths(rules, vocabulary) if lengths is None else lengths
    symbols = symbols.astype(np.uint32)
    sizes = np.ones(vocabulary + len(rules), np.int64)
    sizes[vocabulary:] = lengths
    long = sizes > SHORT
    while len(at := np.flatnonzero(long[symbols])):
        twice = np.ones(len(symbols), np.int64)
        twice[at] = 2
        parts = rules[symbols[at] - np.uint32(vocabulary)]
        symbols = np.repeat(symbols, twice)
        at += np.arange(len(at))
        symbols[at], symbols[at + 1] = parts[:, 0], parts[:, 1]
    sizes[long] = 0
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), "<u4")
    flat[:vocabulary] = np.arange(vocabulary)
    for start, stop in levels(rules, vocabulary):
        short = np.flatnonzero(~long[vocabulary + start : vocabulary + stop]) + start
        if len(short):
            # these lie one after the other, for long ones take no room
            written, _ = _gathered(flat, starts, sizes, rules[short].ravel())
            begin = int(starts[vocabulary + short[0]])
            flat[begin : begin + len(written)] = written
    return _gathered(flat, starts, sizes, symbols)[0]


class Block:
    """A block of a shard, over its bytes."""

    def __init__(self, raw: memoryview) -> None:
        (self.size, self.shard, self.before, docs, n_rules, n_symbols, width, self.vocabulary, self.end) = HEADER.unpack_from(raw, 4)
        at = 4 + HEADER.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.flags, self.lengths, self.counts = part("<i8", docs), part("u1", docs), part("<u4", docs), part("<u4", docs)
        self.rules, self.expansions = part("<u4", 2 * n_rules).reshape(-1, 2), part("<u4", n_rules)
        wide = np.zeros((n_symbols, 4), "u1")
        wide[:, :width] = part("u1", n_symbols * width).reshape(-1, width)
        self.symbols = wide.view("<u4").ravel()

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.vocabulary, self.expansions)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the block, decoding only the symbols that hold them."""
        sizes = np.concatenate([np.ones(self.vocabulary, np.int64), self.expansions])[self.symbols]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return expand(self.symbols[a:b], self.rules, self.vocabulary, self.expansions)[skip : skip + max(0, stop - start)]


def block_bytes(shard: int, before: int, docs: list[tuple[int | None, bool, int]], ids: np.ndarray, vocabulary: int, end: int = END) -> bytes:
    """A block of documents (doc_id, whether it goes on, number of ids) with the given ids."""
    symbols, counts, rules = pack(ids, np.array([n for _, _, n in docs], np.int64), vocabulary, end)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 3
    body = [
        np.array([d or 0 for d, _, _ in docs], "<i8"),
        np.array([(d is None) + 2 * on for d, on, _ in docs], "u1"),
        np.array([n for _, _, n in docs], "<u4"),
        counts.astype("<u4"),
        rules.astype("<u4"),
        expansion_lengths(rules, vocabulary).astype("<u4"),
        symbols.astype("<u4").view("u1").reshape(-1, 4)[:, :width],
    ]
    size = 4 + HEADER.size + sum(x.nbytes for x in body)
    return MAGIC + HEADER.pack(size, shard, before, len(docs), len(rules), len(symbols), width, vocabulary, end) + b"".join(x.tobytes() for x in body)


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes whole texts, each followed by `end`, into shard files below `path`, in ascending doc_id order."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = chosen.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, before = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        docs_in, parts, held = [], [], 0
        last = end.to_bytes(4, "little")

        def flush():
            nonlocal before, docs_in, parts, held
            block = block_bytes(shard, before, docs_in, np.frombuffer(b"".join(parts), "<u4"), encoder.vocabulary, end)
            before += held
            docs_in, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["value"])

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SOME):
                    rows = batch.slice(at, SOME)
                    for key, codes in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist()), strict=True):
                        n = 0
                        for code in (c[i : i + 4 * BLOCK] for c in codes for i in range(0, len(c), 4 * BLOCK)):
                            parts.append(code)
                            n, held = n + len(code) // 4, held + len(code) // 4
                            if held >= BLOCK:
                                docs_in.append((key, True, n))
                                n = 0
                                yield flush()
                        parts.append(last)
                        held += 1
                        docs_in.append((key, False, n + 1))
                        if held >= BLOCK:
                            yield flush()
            if docs_in:
                yield flush()
        finally:
            release_later(tokenizer)
            release_memory()

    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def blocks(raw: bytes) -> Iterator[Block]:
    """The blocks of a shard file."""
    view, at = memoryview(raw), 0
    while at + 4 + HEADER.size <= len(view):
        if view[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        block = Block(view[at:])
        yield block
        at += block.size + 1  # the writer's line break


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of each document in the shard files below `path`; start counts ids over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                crc = n = 0
                start = None
                for block in blocks(raw.as_buffer()):
                    ids, rows, at = memoryview(block.ids()).cast("B"), [], 0
                    for key, flag, length in zip(block.doc_ids.tolist(), block.flags.tolist(), block.lengths.tolist(), strict=True):
                        start = block.before + at // 4 if start is None else start
                        crc, n, at = zlib.crc32(ids[at : at + 4 * length], crc), n + length, at + 4 * length
                        if not flag & 2:
                            rows.append((None if flag & 1 else key, start, n, crc, block.shard))
                            crc, n, start = 0, 0, None
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "local", "n_tokens", "ids_crc32", "shard"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = landed(files.mapInArrow(run, "doc_id long, local long, n_tokens long, ids_crc32 long, shard long"), "token-index")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard file
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_and_read(docs: DataFrame) -> DataFrame:
    path = work_path(docs.sparkSession, "tokens")
    write_shards(docs, path, default_tokenizer())
    return read_shards(docs.sparkSession, path)


def op10_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    return write_and_read(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
