"""Hard negatives by inverted lists with bounds.

Lists. K-means over a bounded sample (SAMPLE rows, those of the smallest hashes) gives about one centroid for LIST_ROWS rows, at most MOST_LISTS. Every row is put
in the list of its nearest centroid, and each list keeps its number of rows and its radius, the greatest distance of a row to the centroid. Lists are packed into
buckets of about BUCKET_ROWS rows: small lists share one, a large list (of many copies, say) is cut into several.

Search. For an anchor a and a list with centroid c and radius r, a's product with any row of the list is at most a.c + |a| r and at least
a.c - |a| r (Cauchy-Schwarz). An anchor asks for the best rows within windows [lowest, highest] of scores. It visits the FIRST lists of the greatest
bounds, of those that meet a window; these give each window its kth score. Then it visits each other list unless its bound is strictly below the kth score of
every window that the list meets, or it meets none. Ties at the kth score are so all seen, and the result is exact. An anchor goes once to each bucket in which
it visits a list, and the products of a bucket's rows with a block of anchors are one matrix product; a task holds a bucket and one
block of at most BLOCK_ANCHORS anchors.

Positives are a search among rows of the anchor's label with one window of all scores; negatives one among rows of other labels with a window for each
positive: 30 positive <= 100 negative <= 90 positive.

Defined results: rows of null vec_id, label, vector, or of any null or non-finite component take no part; shorter vectors have zeros after their
end, an empty one is zero; each row counts, so that repeated rows are others to each other and an anchor that is repeated is mined for each
time; rows of equal score and vec_id are interchangeable; windows of negative scores are empty; no anchor, no positive or no negative gives no row. Products
are computed exactly; one that no long holds becomes the nearest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import landed, read_table, scratch

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a negative's has.
WINDOW = (30, 90)
EVERY = 100
SAMPLE = 8192
ROUNDS = 8
LIST_ROWS, FEWEST_LISTS, MOST_LISTS = 1024, 8, 256
BUCKET_ROWS = 8192
BLOCK_ANCHORS = 16384
#: Anchors of one matrix product.
TOGETHER = 256
FIRST = 4
ANY = (1 - (1 << 63), (1 << 63) - 1)
HITS = "anchor long, slot int, score long, vec_id long, row long"


def quantised(component: Column) -> Column:
    return F.floor(component.cast("double") * 256).cast("double")


def participants(rows: DataFrame, vec_id: Column, vector: Column, label: Column) -> DataFrame:
    """(row, vec_id, label, q): the rows that take part, their components quantised; written. All q have one length."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf")))
    chosen = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite)
    # a double, as floor() to a long would cut what is beyond one
    exact = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, quantised(x)).otherwise(x.cast("double") * 256))
    out = landed(chosen.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", exact.alias("q")), "vectors")
    size = out.agg(F.max(F.size("q"))).first()[0] or 0
    return out.withColumn("q", F.concat("q", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("q"))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows; all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' exactly, as int64. Doubles add whole numbers exactly below 2^53; beyond, Python's integers do."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, *ANY).astype(np.int64)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows of the sample; a centroid without rows stays."""
    found = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(sample, found)[0]
        counts = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it."""
    near = (np.einsum("ij,ij->i", found, found) - 2 * rows @ found.T).argmin(axis=1)
    return near, np.linalg.norm(rows - found[near], axis=1)


class Lists:
    """The centroids with their radii, numbers of rows and buckets: at most MOST_LISTS of each."""

    def __init__(self, centres: np.ndarray, sizes: np.ndarray, radii: np.ndarray, bucket_rows: int = BUCKET_ROWS) -> None:
        self.centres, self.radii = centres, radii
        self.norms = np.linalg.norm(centres, axis=1)
        #: First bucket and number of buckets of each list.
        self.first, self.parts = np.zeros(len(sizes), int), np.maximum(1, -(-sizes // bucket_rows))
        at = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > bucket_rows:
                at, held = at + 1, 0
            self.first[i] = at
            held += n
            if self.parts[i] > 1:
                at, held = at + int(self.parts[i]), 0
        self.buckets = at + 1

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each anchor can have in each list, rounding allowed for."""
        norms = np.linalg.norm(anchors, axis=1)[:, None]
        middle, reach = anchors @ self.centres.T, norms * self.radii
        slack = 1e-9 * norms * (self.norms + self.radii) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def visits(self, anchors: np.ndarray, low: list[list[int]], high: list[list[int]], kth: list[list[int]], again: bool, first: int = FIRST) -> list[np.ndarray]:
        """For each anchor the lists that it visits: the `first` ones by bound, or, `again`, those that are left and not below the kth scores."""
        least, most = self.bounds(anchors)
        out = []
        for i in range(len(anchors)):
            lo, hi, floor = (np.array(x[i], float)[:, None] for x in (low, high, kth))
            meets = (most[i] >= lo) & (least[i] <= hi)
            order = np.argsort(-most[i], kind="stable")
            order = order[meets.any(axis=0)[order]]
            if again:
                order = order[first:]
                order = order[(meets & (most[i] >= floor)).any(axis=0)[order]]
            else:
                order = order[:first]
            out.append(order)
        return out


def index(rows: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Lists | None]:
    """(`rows` with list and bucket, written; the lists), or None for them if there are no rows."""
    count = rows.count()
    if not count:
        return rows, None
    taken = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("q").toArrow()
    centres = centroids(matrix(taken.column("q")), min(MOST_LISTS, max(FEWEST_LISTS, count // list_rows)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = nearest(matrix(batch.column("q")), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names, "list", "distance"])

    listed = landed(rows.select("row", "vec_id", "label", "q").mapInArrow(assign, "row long, vec_id long, label long, q array<double>, list int, distance double"), "lists")
    sizes, radii = np.zeros(len(centres), int), np.zeros(len(centres))
    for i, n, far in listed.groupBy("list").agg(F.count("*"), F.max("distance")).collect():  # at most MOST_LISTS rows
        sizes[i], radii[i] = n, far
    lists = Lists(centres, sizes, radii, bucket_rows)
    first, parts = (F.array(*(F.lit(int(x)) for x in v))[F.col("list")] for v in (lists.first, lists.parts))
    return listed.withColumn("bucket", first + F.pmod(F.xxhash64("row"), parts.cast("long")).cast("int")), lists


def search(listed: DataFrame, lists: Lists, anchors: DataFrame, blocks: int, k: int, same_label: bool) -> DataFrame:
    """(anchor, slot, score, vec_id, row): for each row of `anchors` (anchor, label, q, block, low, high; windows are arrays) and each of its windows the first `k` rows, by
    score and then vec_id, among other rows of its label or of other labels."""
    found = _visited(listed, lists, anchors.withColumn("kth", F.col("low")), blocks, k, same_label, again=False)
    by_rank = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    found = landed(_best(found, k), "first-visits")
    last = found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("full"))
    slots = F.sequence(F.lit(0), F.size("low") - 1)
    kth = F.transform(slots, lambda s: F.coalesce(F.try_element_at("full", s), F.col("low")[s]))
    later = anchors.join(last, "anchor", "left").withColumn("kth", F.when(F.size("low") > 0, kth).otherwise(F.col("low"))).drop("full")
    found = found.unionByName(_visited(listed, lists, later, blocks, k, same_label, again=True))
    return landed(_best(found, k), "hits")


def _best(hits: DataFrame, k: int) -> DataFrame:
    by_rank = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("_rank", F.row_number().over(by_rank)).filter(F.col("_rank") <= k).drop("_rank")


_ASKED = "anchor long, label long, q array<double>, block int, low array<long>, high array<long>, kth array<long>, bucket int, visits array<int>"


def _visited(listed: DataFrame, lists: Lists, anchors: DataFrame, blocks: int, k: int, same_label: bool, again: bool) -> DataFrame:
    """The best rows of each bucket for the anchors that visit a list in it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                low, high, kth = (part.column(c).to_pylist() for c in ("low", "high", "kth"))
                take, buckets, visits = [], [], []
                for i, chosen in enumerate(lists.visits(matrix(part.column("q")), low, high, kth, again)):
                    by_bucket: dict[int, list[int]] = {}
                    for which in chosen.tolist():
                        for bucket in range(lists.first[which], lists.first[which] + lists.parts[which]):
                            by_bucket.setdefault(int(bucket), []).append(which)
                    take += [i] * len(by_bucket)
                    buckets += by_bucket
                    visits += by_bucket.values()
                if take:
                    asked = part.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(buckets, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*asked.schema.names, "bucket", "visits"])

    asked = anchors.select("anchor", "label", "q", "block", "low", "high", "kth").mapInArrow(ask, _ASKED)
    rows = listed.select("row", "vec_id", "label", "q", "list", "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInArrow(_scored(k, same_label), HITS)


def _scored(k: int, same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            q = matrix(rows.column("q"))
            row, vec_id, label, which = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label", "list"))
            for at in range(0, asked.num_rows, TOGETHER):
                part = asked.slice(at, TOGETHER)
                scores = products(matrix(part.column("q")), q)
                columns = [part.column(c).to_pylist() for c in ("anchor", "label", "low", "high", "kth", "visits")]
                for score, anchor, own, low, high, kth, visits in zip(scores, *columns, strict=True):
                    ok = (score >= min(kth)) & (score <= max(high)) & np.isin(which, visits) & ((label == own) == same_label) & (row != anchor)
                    at_all = np.flatnonzero(ok)
                    at_all = at_all[np.argsort(-score[at_all], kind="stable")]
                    falling = -score[at_all]
                    for slot, (floor, top) in enumerate(zip(kth, high, strict=True)):
                        start, end = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -floor, "right")
                        best = at_all[start : min(end, start + k)]
                        for held, values in zip(out, (np.full(len(best), anchor), np.full(len(best), slot), score[best], vec_id[best], row[best]), strict=True):
                            held.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, int), f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def mine(
    rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, **sizes: int
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows whose vec_id `every` divides."""
    with scratch(rows.sparkSession):
        return landed(_mine(rows, vec_id, vector, label, every, positives, negatives, window, sizes), "negatives", keep=True)


def _mine(rows: DataFrame, vec_id: str, vector: str, label: str, every: int, positives: int, negatives: int, window: tuple[int, int], sizes: dict[str, int]) -> DataFrame:
    part = participants(rows, *(F.col(f"`{c}`") for c in (vec_id, vector, label)))
    listed, lists = index(part, **sizes)
    anchors = listed.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q")
    if lists is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    anchors = landed(anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")), "anchors")
    whole = [F.array(F.lit(x).cast("long")).alias(n) for x, n in zip(ANY, ("low", "high"), strict=True)]
    near = search(listed, lists, anchors.select("*", *whole), blocks, positives, same_label=True)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = near.withColumn("slot", F.row_number().over(order) - 1).select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = landed(near, "positives")
    # whole scores s with window[0] p <= 100 s <= window[1] p
    low, high = (F.expr(f"{f}(CAST(positive_score AS DECIMAL(20, 0)) * {w} / 100)").cast("long") for f, w in (("ceil", window[0]), ("floor", window[1])))
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", low.alias("low"), high.alias("high")))).alias("w"))
    asking = anchors.join(windows, "anchor").withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high")).drop("w")
    far = search(listed, lists, asking, blocks, negatives, same_label=False)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")))
    out = ranked.join(near, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's rows: the label of every seventh vec_id is moved on by one of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of all anchors among all rows."""
    return mine(relabelled(read_table(spark, sf_dir, "embeddings")))


OP11_SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
  pos AS (SELECT a, b, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES}),
  neg AS (SELECT pos.a, pos.b AS positive, pos.s AS ps, p.b AS negative, p.s AS ns, row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY p.s DESC, p.b) AS rank
    FROM pos JOIN p ON p.a = pos.a AND NOT p.same AND {WINDOW[0]} * pos.s <= 100 * p.s AND 100 * p.s <= {WINDOW[1]} * pos.s)
  SELECT a AS anchor_id, positive AS positive_id, rank::INT AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE rank <= {NEGATIVES}"""
