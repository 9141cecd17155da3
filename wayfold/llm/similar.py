"""Near copies by word shingles: pairs whose sets of shingles have a Jaccard similarity of SIMILARITY or more.

SimHash links at three bits find copies with a change or two; pairs at the similarity of 0.8 differ in 4 to 14 bits, beyond what segment
decoding reaches. This stage finds them in two passes, neither of which compares all pairs:

1. BANDS keys of ROWS minima each, within classes of set size. A pair at 0.8 shares one of 8 x 3 with a chance of 0.997 only, so this pass
   but shrinks the groups: the texts of a key are compared with two of them, the smallest and the largest by hash.
2. The prefix filter, over all texts, which loses no pair. In any order that is the same for all sets, two sets of the similarity share k of
   the first n - similarity x n + k of their n shingles, for any k; with k = SHARED x n, a passage that two texts have in common seldom
   suffices. The order here is by how often a bounded sample of texts has a shingle; it decides how many texts are suspect, not what is found.
   Suspects whose first shingles lead to another component are then ordered exactly, by how many of these texts have a shingle; those rarest
   shingles are keys in turn: first hubs, then what is left.

Defined results: words are split at white space after lower-casing A-Z; a text of fewer words than a shingle has one shingle, the whole
sequence; texts without words link to none here.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import append_columns, join_ids, landed, scratch, under_own_names, utf8
from .components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS = 5
SIMILARITY = 0.8
#: Of a set's shingles, the share of its prefix that another set of the similarity has in its own, at least.
SHARED = 0.1
BANDS, ROWS = 8, 3
#: Texts, and hashes of each, whose shingles are counted for the order of the prefix filter; shingles that are told apart in it.
SAMPLE_TEXTS, SAMPLE_HASHES, COMMON = 10_000, 5_000, 100_000
_DRAWS = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS, SHIFTS = _DRAWS[0] | np.uint64(1), _DRAWS[1]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.int64)
    k = min(words, len(found))
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(found[i:] for i in range(k)), strict=False)), repeat(0))
    return np.unique(np.fromiter(hashes, np.uint64, len(found) - k + 1).view(np.int64))


def band_keys(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    low = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint64)[None, :]
        low = np.minimum(low, (part * FACTORS + SHIFTS).min(1, keepdims=True))
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def first_of(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - similarity x n + k of a set in the order of (times, hash), in that order; `common` is sorted and has the hashes with times."""
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, often))][: n - math.ceil(n * similarity * (1 - 1e-9)) + math.ceil(n * SHARED)]


def _ends(members: DataFrame) -> DataFrame:
    """`members` of the keys that join different roots, with the first and the last node of the key (low, high)."""
    node = F.struct("node", "root", "n", "at")
    ends = members.groupBy("key").agg(F.min(node).alias("low"), F.max(node).alias("high"), F.min("root").alias("first"), F.max("root").alias("last"))
    return members.join(ends.filter("first <> last").select("key", "low", "high"), "key")


def _possible(similarity: float) -> Column:
    """Whether two sets (na, nb elements) that share a key at places pa and pb of their orders can have the similarity: by size, and by what follows."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    after = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    needed = (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity) * (1 - 1e-9))
    return (small >= F.lit(similarity * (1 - 1e-9)) * large) & (after >= needed)


def _side(name: str, of: str = "") -> list[Column]:
    """A member's columns as side a or b of a pair."""
    return [F.col(f"{of}{c}").alias(new) for c, new in (("node", name), ("root", f"r{name}"), ("n", f"n{name}"), ("at", f"p{name}"))]


def _hub_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each member with both ends of its key, once each."""
    ends = _ends(members)
    sides = [ends.select(*_side("a"), *_side("b", f"{end}.")) for end in ("low", "high")]
    return sides[0].union(sides[1]).filter("ra <> rb").filter(_possible(similarity)).select("a", "b", "ra", "rb").distinct()


def _moved(rows: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` with their root replaced where `links` (node, root) leads on."""
    on = links.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return rows.join(on, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def _rare_members(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, root, n, at): each node's rarest shingles that other roots of `nodes` (node, root, n) have too, and their places in its order.

    Shingles of one root alone come first in the order; they join nothing, so only their number is kept.
    """
    rows = nodes.join(sets.select(F.col("row").alias("node"), "shingles"), "node").select("node", "root", "n", F.explode("shingles").alias("key"))
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "times")
    of_node = Window.partitionBy("node")
    ranked = rows.join(often, "key").withColumn("shared", F.count(F.lit(1)).over(of_node)).withColumn("nth", F.row_number().over(of_node.orderBy("times", "key")))
    placed = ranked.withColumn("at", F.col("n") - F.col("shared") + F.col("nth"))
    return placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity * (1 - 1e-9))) + 1).select("key", "node", "root", "n", "at")


def _common(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of about SAMPLE_TEXTS rows of `docs`, sorted, and how many of these have each."""
    place = F.pmod(F.xxhash64("row", F.lit("order")), F.lit(1 << 30))
    sample = docs.filter(place < int(min(1.0, SAMPLE_TEXTS / max(1, docs.count())) * (1 << 30)))

    def make():
        return lambda batch: [pa.array([shingles(x, words)[:SAMPLE_HASHES] for x in utf8(batch.column(text))], pa.list_(pa.int64()))]

    rows = append_columns(sample, [text], [T.StructField("hashes", T.ArrayType(T.LongType()))], make, ["row"]).select(F.explode("hashes").alias("hash"))
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").orderBy(F.desc("times"), "hash").limit(COMMON).toArrow()
    common, times = (often.column(c).to_numpy() for c in ("hash", "times"))
    by_hash = np.argsort(common)
    return common[by_hash], times[by_hash]


def _by_class(rows: DataFrame, similarity: float) -> DataFrame:
    """`rows` (key, n and others) twice, with keys by class of size: sets of similar sizes are of one class or of two neighbouring ones."""
    size_class = F.floor(F.log("n") / F.lit(math.log(1 / similarity) + 1e-9))
    both = F.array(F.xxhash64("key", size_class), F.xxhash64("key", size_class + 1))
    return rows.select(F.explode(both).alias("key"), *(c for c in rows.columns if c != "key"))


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """`rows` of the keys that have more than one `by`. Rows are dealt by key once, for the count and for the join."""
    rows = rows.repartition("key")
    several = rows.groupBy("key").agg(F.min(by).alias("low"), F.max(by).alias("high")).filter("low <> high").select("key")
    return rows.join(several, "key", "left_semi")


def _keyed(docs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """(node, keys, firsts, n) of each different `row` of `docs` whose text has a shingle: keys of minima, first shingles, size of the set."""
    kind = T.ArrayType(T.LongType())
    common, times = _common(docs, text, words)
    order = docs.sparkSession.sparkContext.broadcast((common, times))

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            bands, firsts, sizes = [], [], []
            for x in utf8(batch.column(text)):
                found = shingles(x, words)
                bands.append(band_keys(found))
                firsts.append(first_of(found, *order.value, similarity))
                sizes.append(len(found))
            return [pa.array(bands, kind_of), pa.array(firsts, kind_of), pa.array(sizes, pa.int64())]

        kind_of = pa.list_(pa.int64())
        return compute

    fields = [T.StructField("keys", kind), T.StructField("firsts", kind), T.StructField("n", T.LongType())]
    keyed = append_columns(docs, [text], fields, make, ["row"]).filter("n > 0")
    return landed(keyed.groupBy(F.col("row").alias("node")).agg(*(F.first(c).alias(c) for c in ("keys", "firsts", "n"))), "keyed")


def _marks(docs: DataFrame, text: str, words: int, similarity: float, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n, at, root) of the texts of `docs` (row, the text) that can have near copies: keys of minima by class of size, and
    first shingles, those that other such texts have too. Equal texts, those with one `row`, have their keys once."""
    with scratch(docs.sparkSession):
        return _marks_of(_keyed(docs, text, words, similarity), similarity, roots)


def _marks_of(keyed: DataFrame, similarity: float, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    sizes = keyed.select("node", "n")

    def enough(rows: DataFrame) -> DataFrame:
        """`rows` of nodes that share as many keys as the smallest set that is similar needs."""
        counted = rows.groupBy("node").agg(F.count(F.lit(1)).alias("shares")).join(sizes, "node")
        needed = F.ceil(F.ceil(F.col("n") * F.lit(similarity * (1 - 1e-9))) * F.lit(SHARED * (1 - 1e-9)))
        return landed(rows.join(counted.filter(F.col("shares") >= needed).select("node", "n"), "node"), "enough")

    def started(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"root": F.col("node"), "at": F.lit(1).cast("long")})
        return rows if roots is None else _moved(rows, roots)

    firsts = enough(landed(_shared(keyed.select(F.explode("firsts").alias("key"), "node"), "node"), "shared"))
    firsts = enough(landed(_shared(firsts.select("key", "node"), "node"), "shared"))
    suspects = firsts.select("node").distinct()
    banded = _by_class(keyed.join(suspects, "node", "left_semi").select(F.explode("keys").alias("key"), "node", "n"), similarity).distinct()
    return landed(started(_shared(banded, "node")), "members", keep=True), landed(started(firsts), "firsts", keep=True)


def _sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(row, shingles) of each different row of `docs`."""
    kind = T.ArrayType(T.LongType())

    def make():
        return lambda batch: [pa.array([shingles(x, words) for x in utf8(batch.column(text))], pa.list_(pa.int64()))]

    sets = append_columns(docs, [text], [T.StructField("shingles", kind)], make, ["row"])
    return landed(sets.groupBy("row").agg(F.first("shingles").alias("shingles")), "shingles")


def _linked(members: DataFrame, firsts: DataFrame, sets: DataFrame, similarity: float, roots: DataFrame | None) -> DataFrame:
    """(row, root) of the texts whose components have others: by keys of minima, then by rarest shingles."""

    def linked(pairs: DataFrame) -> DataFrame:
        """Components of the roots (ra, rb) of those pairs (a, b) that have the similarity."""
        pairs = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), "a")
        pairs = pairs.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        alike = pairs.filter(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both))
        return connected_components(alike.select(F.col("ra").alias("a"), F.col("rb").alias("b")))

    by_band = linked(_hub_pairs(members, similarity))
    found = members.select("node", "root").union(firsts.select("node", "root")).distinct() if roots is None else roots.select("node", "root")
    found = landed(_moved(found, by_band), "by-band")
    still_open = _shared(_by_class(_moved(firsts, by_band), similarity), "root").select("node", "root", "n").distinct()
    rare = landed(_rare_members(landed(still_open, "open"), sets, similarity), "rare")
    by_hub = linked(_hub_pairs(rare, similarity))
    rare = landed(_ends(_moved(rare, by_hub)).drop("low", "high"), "open-rare")
    x, y = rare.select("key", *_side("a")), rare.select("key", *_side("b"))
    left = x.join(y, (x["key"] == y["key"]) & (F.col("ra") < F.col("rb")) & _possible(similarity)).select("a", "b", "ra", "rb").distinct()
    found = _moved(_moved(found, by_hub), linked(left))
    grouped = found.groupBy("root").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("root")
    return found.join(grouped, "root", "left_semi").select(F.col("node").alias("row"), "root")


def groups(docs: DataFrame, *, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, roots: DataFrame | None = None) -> DataFrame:
    """(row, root) of the rows of `docs` (row, a long that names the text, and the text) that are near copies of others.

    `roots` (node, root, each row once) are components that other links have made; its rows are joined on through links of any member."""
    members, firsts = _marks(docs, text, words, similarity, roots)
    suspects = firsts.select(F.col("node").alias("row")).distinct()
    return _linked(members, firsts, _sets(docs.join(suspects, "row", "left_semi"), text, words), similarity, roots)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bits: bool = False) -> DataFrame:
    """One document of each group of near copies, in the columns of `docs`: that with the smallest doc_id, one with an id before those
    without; of equal ids and of equal rows any one. A null or wordless text is a copy of others of its kind if `bits` is set, else it stays.

    With `bits`, SimHash links count too: groups are the components of both kinds of links over all documents, so that a link through
    a document that goes isn't lost.

    Texts that nothing points to are written apart first; what else is decided, is decided on the others' hashes and ids. Whole texts are
    never sorted, and shuffled only where the ids of suspects or losers are too many to broadcast."""

    def step(d: DataFrame, c: dict[str, str]) -> DataFrame:
        key, body = F.col(c[doc_id]), c[text]
        node = F.xxhash64(F.coalesce(F.col(body), F.lit(""))).alias("_node")
        texts = d.select(node.alias("row"), F.col(body).alias("text"))
        roots = None
        if bits:
            with scratch(d.sparkSession):
                linked = simhash.near_duplicates(texts, doc_id="row", text="text", words=words)
                roots = landed(linked.select(F.col("row").alias("node"), F.col("component_id").alias("root")).distinct(), "simhash-roots", keep=True)
        members, firsts = _marks(texts, "text", words, similarity, roots)
        suspects = firsts.select("node", F.lit(True).alias("_link")).distinct()
        others = texts.groupBy(F.col("row").alias("node")).count().filter("count > 1").select("node")
        if roots is not None:
            several = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("root")
            others = others.union(roots.join(several, "root", "left_semi").select("node"))
        suspects = suspects.union(others.select("node", F.lit(False)).distinct()).groupBy(F.col("node").alias("_node")).agg(F.max("_link").alias("_link"))
        dealt = join_ids(d.select("*", node, F.monotonically_increasing_id().alias("_uid")), landed(suspects, "suspects"), "_node", "left")
        dealt = landed(dealt.withColumn("_suspect", F.col("_link").isNotNull()), "dealt", by="_suspect", keep=True)
        doubtful = dealt.filter("_suspect")
        with scratch(d.sparkSession):
            sets = _sets(doubtful.filter("_link").select(F.col("_node").alias("row"), F.col(body).alias("text")), "text", words)
            found = landed(_linked(members, firsts, sets, similarity, roots), "similar", keep=True)
        order = F.struct(key.isNull().alias("n"), key.alias("d"), "_uid")
        grouped = doubtful if bits else doubtful.filter(F.col(body).rlike(r"[^\x20\x09-\x0D]"))
        ranked = grouped.select(F.col("_node").alias("row"), order.alias("order")).join(found, "row", "left")
        ranked = landed(ranked.select("order", F.coalesce("root", "row").alias("root")), "ranked")
        best = ranked.groupBy("root").agg(F.min("order").alias("best"))
        losers = ranked.join(best, "root").filter("order <> best").select(F.col("order._uid").alias("_uid"))
        return dealt.filter("NOT _suspect").unionByName(join_ids(doubtful, landed(losers, "losers", keep=True), "_uid", "left_anti"))

    with scratch(docs.sparkSession):
        return under_own_names(docs, step)
