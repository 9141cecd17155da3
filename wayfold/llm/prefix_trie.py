"""The trie of conversation prefixes by prefix-doubling naming.

Order. Turns are range-sorted by conversation, turn (null first), role and text, so that a conversation of any share of the rows is spread over many tasks; a turn's
place is its number in the whole order less that of its conversation's first turn, numbers being counted by partition.

Rebuilding. Conversation c has h = crc32(c in decimal) mod FOLD. It takes the first h turns of conversation c - c mod GROUP and then its own after its first h.

Naming. Level 0 names the different turns; a block of 2^k turns that starts at a multiple of 2^k is named by the pair of its halves' names. Names
are dense: the different keys are written once and numbered by the counts of the partitions before. A round joins a level's blocks to the
names of their keys, so there are as many rounds as the longest conversation has bits. Prefixes are composed from the top level down: a prefix
of m blocks of size 2s is one of 2m blocks of size s, and with the next block of size s, where there is one, the prefix of 2m + 1. A
prefix is then known by its length and the names of its blocks, one for each bit of its length, and these are the nodes' keys.

Nodes. A node is led by its smallest member; who leads a node leads those below it that it's in, so a node is known by its leader and depth. Sums over
a subtree are sums over members: each member brings what the nodes bring that it leads below. No step goes through the depth.

Defined results: null roles and texts are empty; rows of null conv_id take no part; turns that tie are ordered by role, then text, and repeated rows
are turns each; conv_id and turn are integers; a conversation whose group's first is absent takes nothing from it; an empty table has no conversation and
so no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import landed, read_table, scratch

GROUP, FOLD = 5, 9
#: Turns of a conversation whose sums one task makes.
STRETCH = 4096
#: Members whose ids are joined to one string before a node's strings are hashed.
TOGETHER = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def dense(rows: DataFrame, mark: str, name: str) -> DataFrame:
    """`rows` of a written table, whose column `mark` was made by monotonically_increasing_id, with numbers from 0 without gaps in its place."""
    part, at = F.shiftright(mark, 33), F.col(mark).bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each partition of the table
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + at).drop("_part", "_offset", *([mark] if mark != name else []))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with a dense `name` for each different value of `keys`, which go; written."""
    known = landed(rows.select(*keys).distinct().withColumn("_mark", F.monotonically_increasing_id()), "keys")
    return landed(rows.join(dense(known, "_mark", "name"), keys).drop(*keys), "named")


def ordered_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, at, turn_digest, bytes): the turns with their places from 0 in their conversation, and (second) the conversations (conv, n)."""
    chosen = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))),
    ).filter("conv IS NOT NULL")
    # equal rows are interchangeable, so the salt that spreads them needn't be the same in a retry
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    placed = chosen.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text"), 256))
    rows = landed(placed.select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("mark")), "turns")
    return dense(rows, "mark", "number")


def rebuilt(turns: DataFrame, group: int = GROUP, fold: int = FOLD) -> tuple[DataFrame, DataFrame]:
    """(conv, at, digest, bytes) of the rebuilt conversations, and (conv, n): all conversations with their rebuilt lengths."""
    own = landed(turns.groupBy("conv").agg(F.count("*").alias("own"), F.min("number").alias("start")), "conversations")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % fold
    base = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = own.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("head", head).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("base_own", F.lit(0))))
    convs = landed(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "plan")
    numbered = turns.join(convs.select("conv", "start", "head", "taken"), "conv").withColumn("place", F.col("number") - F.col("start"))
    tails = numbered.filter("place >= head").select("conv", (F.col("place") - F.col("head") + F.col("taken")).alias("at"), "digest", "bytes")
    firsts = numbered.filter(f"place < {fold} AND conv % {group} = 0").select(F.col("conv").alias("base"), F.col("place").alias("at"), "digest", "bytes")
    heads = firsts.join(convs.select("conv", "base", "taken"), "base").filter("at < taken").select("conv", "at", "digest", "bytes")
    return tails.unionByName(heads), convs.select("conv", "n")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, names, bytes): each prefix of each conversation with the names of its blocks, longest first, and the bytes of its last text."""
    levels = [named(turns, ["digest"])]
    longest = convs.agg(F.max("n")).first()[0] or 0
    for _ in range(1, int(longest).bit_length()):
        even = F.col("at") % 2 == 0
        halves = levels[-1].groupBy("conv", F.floor(F.col("at") / 2).alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("first"), F.max(F.when(~even, F.col("name"))).alias("second"), F.max(F.when(~even, F.col("bytes"))).alias("bytes"),
        )
        pairs = halves.filter("first IS NOT NULL AND second IS NOT NULL").withColumnRenamed("half", "at")
        levels.append(named(pairs, ["first", "second"]))
    out = convs.select("conv", F.lit(0).cast("long").alias("m"), F.array().cast("array<long>").alias("names"), F.lit(0).cast("long").alias("bytes"))
    for blocks in reversed(levels):
        doubled = out.withColumn("m", F.col("m") * 2).join(blocks.select("conv", F.col("at").alias("m"), "name", F.col("bytes").alias("block_bytes")), ["conv", "m"], "left")
        shorter = F.struct("m", "names", "bytes")
        longer = F.struct((F.col("m") + 1).alias("m"), F.concat("names", F.array("name")).alias("names"), F.col("block_bytes").alias("bytes"))
        out = doubled.select("conv", F.inline(F.when(F.col("name").isNull(), F.array(shorter)).otherwise(F.array(shorter, longer))))
    return out.withColumnRenamed("m", "depth")


def _by_stretch(rows: DataFrame, value: str, total: str) -> DataFrame:
    """`rows` (conv, depth, ...) with `total`, the sum of `value` over the conversation's rows of this depth and below; stretches of a long one are summed apart."""
    rows = rows.withColumn("_stretch", F.floor(F.col("depth") / STRETCH))
    sums = rows.groupBy("conv", "_stretch").agg(F.sum(value).alias("_sum"))
    after = Window.partitionBy("conv").orderBy(F.desc("_stretch"))
    later = sums.select("conv", "_stretch", (F.sum("_sum").over(after) - F.col("_sum")).alias("_later"))
    within = Window.partitionBy("conv", "_stretch").orderBy(F.desc("depth"))
    return rows.withColumn("_within", F.sum(value).over(within)).join(later, ["conv", "_stretch"]).withColumn(total, F.col("_within") + F.col("_later")).drop("_stretch", "_within", "_later")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (leader, depth, conv), sorted: strings of at most TOGETHER ids each."""
    key, held = None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"leader": [key[0]], "depth": [key[1]], "first": [held[0]], "ids": [",".join(map(str, held))]}, _JOINED)

    for batch in batches:
        for leader, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and ((leader, depth) != key or len(held) >= TOGETHER):
                yield flush()
                held = []
            key = (leader, depth)
            held.append(conv)
    if held:
        yield flush()


_JOINED = pa.schema([("leader", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("leader", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (leader, depth, first, ids), sorted: a node's strings go through one hash, one after the other."""
    key, state = None, None
    for batch in batches:
        done = []
        for leader, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (leader, depth) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (leader, depth), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _HASHED, strict=True)], schema=_HASHED)
    if key:
        yield pa.RecordBatch.from_pydict({"leader": [key[0]], "depth": [key[1]], "ends_sha256": [state.hexdigest()]}, _HASHED)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(leader, depth, ends_sha256) from rows (leader, depth, conv): SHA-256 of the ids in order. Ids become strings in range-sorted tasks; the task that
    hashes a node's strings, which must go one after the other, holds one at a time."""
    key = ["leader", "depth", "conv"]
    strings = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_joined, "leader long, depth long, first long, ids string")
    return strings.repartition("leader", "depth").sortWithinPartitions("leader", "depth", "first").mapInArrow(_hashed, "leader long, depth long, ends_sha256 string")


def trie(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = GROUP, fold: int = FOLD) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch(turns.sparkSession):
        return landed(_trie(turns, conv_id, turn, role, text, group, fold), "trie", keep=True)


def _trie(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, group: int, fold: int) -> DataFrame:
    parts, convs = rebuilt(ordered_turns(turns, conv_id, turn, role, text), group, fold)
    steps = landed(prefixes(parts, convs), "prefixes")
    groups = steps.groupBy("depth", "names").agg(F.min("conv").alias("leader"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    groups = landed(groups.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "groups")
    # a row for each conversation and depth, with the node that it passes
    walks = landed(steps.join(groups.select("depth", "names", "leader"), ["depth", "names"]).select("conv", "depth", "leader"), "walks")
    above = walks.select("conv", (F.col("depth") + 1).alias("depth"), F.col("leader").alias("parent"))
    nodes = groups.select(F.col("leader").alias("conv"), "depth", "n_convs", "saved").join(above, ["conv", "depth"], "left")
    nodes = landed(_by_stretch(nodes, "saved", "led_saved"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    # what a conversation brings to the nodes that it passes and doesn't lead; one leads at most one leaf, where it ends
    led = nodes.groupBy("conv").agg(F.sum("saved").alias("brings"))
    leaves = nodes.join(children, ["conv", "depth"], "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    brings = landed(convs.select("conv", F.col("n").alias("ends")).join(led, "conv", "left").join(leaves, "conv", "left").fillna(0, ["brings", "leaf"]), "brings")
    passing = walks.join(brings, "conv").groupBy(F.col("leader").alias("conv"), "depth").agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("leader") != F.col("conv"), F.col("brings")).otherwise(0)).alias("others_saved"),
    )
    ends = ends_digests(walks.join(brings.select("conv", F.col("ends").alias("depth")), ["conv", "depth"])).withColumnRenamed("leader", "conv")
    out = nodes.join(passing, ["conv", "depth"]).join(children, ["conv", "depth"], "left").join(ends, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", (F.col("led_saved") + F.col("others_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt."""
    return trie(read_table(spark, sf_dir, "conversations"))


#: crc32 bit by bit: a byte is taken in, then eight steps (-1).
_CRC = (
    "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
)
OP12_SQL = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, c - c % {GROUP} AS base, xor({_CRC}, 4294967295) % {FOLD} AS h, own FROM (SELECT c, count(*) AS own FROM t GROUP BY c)),
  plan AS (SELECT v.c, v.base, v.h, least(v.h, coalesce(b.own, 0)) AS m FROM convs v LEFT JOIN convs b ON v.base = b.c),
  r AS (SELECT p.c, t.place AS pos, role, text FROM plan p JOIN t ON t.c = p.base AND t.place < p.m UNION ALL SELECT p.c, t.place - p.h + p.m, role, text FROM plan p JOIN t ON t.c = p.c AND t.place >= p.h),
  pre AS (SELECT c, pos + 1 AS depth, strlen(text) AS bytes, sha256(string_agg(sha256(role) || sha256(text), '' ) OVER (PARTITION BY c ORDER BY pos)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM plan),
  node AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM pre GROUP BY depth, k),
  w AS (SELECT c, depth, conv_id, n_convs, saved FROM pre JOIN node USING (depth, k)),
  up AS (SELECT DISTINCT b.conv_id, b.depth, a.conv_id AS parent FROM w a JOIN w b ON a.c = b.c AND a.depth = b.depth - 1),
  kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
  n AS (SELECT conv_id, depth, n_convs, saved, parent, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN up USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth)),
  below AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS low_conv, b.depth AS low_depth FROM w a JOIN w b ON a.c = b.c AND b.depth >= a.depth),
  sums AS (SELECT b.conv_id, b.depth, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum(n.saved) AS saved_tokens FROM below b JOIN n ON n.conv_id = low_conv AND n.depth = low_depth GROUP BY ALL),
  last AS (SELECT conv_id, depth, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, max(depth) AS depth FROM pre GROUP BY c) JOIN w USING (c, depth) GROUP BY ALL)
  SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
  FROM n JOIN sums USING (conv_id, depth) LEFT JOIN last USING (conv_id, depth)"""
