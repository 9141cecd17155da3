"""SimHash near-duplicates, found through Golay-code keys.

A fingerprint has a bit for each bit that is set in over half of the XXH64 hashes of the text's word shingles. Fingerprints
link when they differ in at most LINK bits; components of the links are the groups.

Search. 64 bits are cut into segments of 22, 21 and 21 bits. A segment, padded to 23 bits, gets the indices of all codewords of
the perfect Golay code within distance 4: the nearest alone, or that and five more where it is at distance 3. Two segments that
differ in at most one bit share an index, for the nearest codeword of one is within 4 of the other. Of at most three errors
over three segments, either a segment has none, and one of the others at most one (key: the clean segment and an index of the
other), or each has one (key: an index of the first, and a half of each of the others that has no error). Keys hold about 33
bits, so unrelated fingerprints rarely meet.

Large groups. Fingerprints of a key are first linked to the smallest of them where that is near enough; components of these
links shrink the groups. Only keys that still join different components are searched pair by pair, across components. No
candidate is dropped.

Defined results: a null or wordless text has fingerprint zero and links like any other; texts of fewer words than a shingle have
one shingle, the whole sequence; repeated rows get the same answer; a null doc_id is answered but names no component unless it
is alone in it (then null); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, landed, read_table, under_own_names, utf8
from .components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
LINK = 3
#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def shingle_hashes(text: bytes, words_in_shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; of a text of fewer words, that of the whole sequence."""
    words = WORD.findall(text.lower())
    k = min(words_in_shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(k)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority of each bit over the hashes, as a signed number; 0 without any."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words_in_shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, words_in_shingle))


def add_fingerprints(docs: DataFrame, *, text: str = "text", words: int = 5, keep: list[str] | None = None) -> DataFrame:
    """`docs` with fingerprint_bits (long) of shingles of `words` words."""

    def make():
        return lambda batch: [pa.array([fingerprint(x, words) for x in utf8(batch.column(text))], pa.int64())]

    return append_columns(docs, [text], [T.StructField("fingerprint_bits", T.LongType())], make, keep)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of the 12 high bits of a word (the low 11 bits are their own), and for each syndrome six error patterns
    that lead to the codewords within distance 4 (where there is one alone, it is repeated)."""
    high = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        high ^= np.where(high >> bit & 1, GENERATOR << (bit - 11), 0)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            near[int(high[pattern >> 11]) ^ pattern & 2047].append(pattern)
    return high, np.array([(x * 6)[:6] for x in near], np.int64)


_SYNDROMES, _NEAR = golay_tables()


def golay_indices(values: np.ndarray) -> np.ndarray:
    """(n, 6): the 12-bit indices of the codewords within distance 4 of each 23-bit value; an index may repeat."""
    return (values[:, None] ^ _NEAR[_SYNDROMES[values >> 11] ^ values & 2047]) >> 11


def golay_keys(prints: np.ndarray) -> np.ndarray:
    """(n, m) of 64-bit keys; fingerprints that differ in at most three bits share one. Keys may repeat in a row."""
    bits = prints.view(np.uint64)
    parts = [(bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [golay_indices(p) for p in parts]
    keys = []
    for clean in range(3):
        for other in range(3):
            if clean != other:
                keys.append((clean * 3 + other) << 40 | parts[clean][:, None] << 12 | near[other])
    for half_b in range(2):
        for half_c in range(2):
            b, c = ((p >> 11 * half) & 2047 for p, half in ((parts[1], half_b), (parts[2], half_c)))
            keys.append((9 + half_b * 2 + half_c) << 40 | (b << 11 | c)[:, None] << 12 | near[0])
    return np.concatenate(keys, axis=1)


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp), once each. A fingerprint has about 50 keys, so fingerprints are dealt to tasks before they grow."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(at, 4096).to_numpy()
                keys = np.sort(golay_keys(values), axis=1)
                first = np.ones(keys.shape, bool)
                first[:, 1:] = keys[:, 1:] != keys[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.repeat(values, first.sum(1)))], names=["key", "fp"])

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("fp").repartition(tasks, "fp").mapInArrow(run, "key long, fp long")


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= LINK


def linked_groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of nodes that link to others; `members` has (key, node), and verify() keeps of pairs (a, b) those that link.

    Nodes of a key are first linked to the smallest of them; only keys that still join different components are then searched pair by
    pair, across components.
    """
    members = members.repartition("key")
    shared = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("key", "hub")
    members = landed(members.join(shared, "key"), "keys")
    first = connected_components(verify(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()))
    rooted = landed(members.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    open_keys = landed(rooted.join(mixed, "key"), "open")
    x = open_keys.select("key", F.col("node").alias("a"), F.col("root").alias("ra"))
    y = open_keys.select("key", F.col("node").alias("b"), F.col("root").alias("rb"))
    pairs = x.join(y, "key").filter("ra < rb").select("a", "b", "ra", "rb")
    second = connected_components(verify(pairs).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    last = first.union(second.join(first.select("node"), "node", "left_anti").select("node", "root"))
    moved = second.select(F.col("node").alias("root"), F.col("root").alias("moved"))
    return last.join(moved, "root", "left").select("node", F.coalesce("moved", "root").alias("root"))


def group_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints of `prints` (column fp, distinct) that link to others."""
    keyed = _keyed(prints).withColumnRenamed("fp", "node")
    return linked_groups(keyed, lambda pairs: pairs.filter(_near("a", "b"))).withColumnRenamed("node", "fp")


def components(by_print: DataFrame) -> DataFrame:
    """(fp, root) of all fingerprints of `by_print` (fp, least): root is the smallest `least` of the fingerprints that links reach."""
    linked = group_fingerprints(by_print.select("fp"))
    named = landed(by_print.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("group")), "groups")
    return named.join(named.groupBy("group").agg(F.min("least").alias("root")), "group").select("fp", "root")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, fingerprint_bits, component_id) for each row of `docs`; component_id is the smallest doc_id of the group."""
    prints = landed(add_fingerprints(docs, text=text, words=words, keep=[doc_id]), "fingerprints")
    by_print = landed(prints.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min(doc_id).alias("least")), "prints")
    classes = components(by_print).select(F.col("fp").alias("fingerprint_bits"), F.col("root").alias("component_id"))
    return prints.join(classes, "fingerprint_bits", "left").select(doc_id, "fingerprint_bits", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """One document of each group, in the columns of `docs`: that with the smallest doc_id, one with an id before those without; of
    equal ids and of equal rows any one."""

    def step(d: DataFrame, c: dict[str, str]) -> DataFrame:
        numbered = landed(d.withColumn("_uid", F.monotonically_increasing_id()), "numbered")
        key = F.struct(F.col(c[doc_id]).isNull().alias("n"), F.col(c[doc_id]).alias("d"), "_uid")
        groups = near_duplicates(numbered.select(key.alias("key"), F.col(c[text]).alias("text")), doc_id="key", text="text", words=words)
        winners = landed(groups.filter("key = component_id").select(F.col("key._uid").alias("_uid")), "winners")
        return numbered.join(winners.hint("shuffle_hash"), "_uid", "left_semi")

    return under_own_names(docs, step)


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; shingles of three words."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")
