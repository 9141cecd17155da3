"""Hard negatives, the prefix trie and token counts against plain versions, through their queries, on odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayfold.llm import hard_negatives, prefix_trie, token_counts
from wayfold.llm.common import numbered

# --- hard negatives


def plain_negatives(rows, every=100):
    taken = [(i, v, y, [math.floor(256 * float(x)) for x in e]) for i, (v, e, y) in enumerate(rows)
             if v is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    size = max((len(q) for *_, q in taken), default=0)
    taken = [(i, v, (y + 1) % 10 if v % 7 == 0 else y, q + [0] * (size - len(q))) for i, v, y, q in taken]
    out = []
    for i, v, y, q in taken:
        if v % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), w, j, z) for j, w, z, p in taken if j != i)
        for s, w, _, z in [r for r in scored if r[3] == y][:5]:
            far = [r for r in scored if r[3] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(v, w, k + 1, u, -s, -t) for k, (t, u, _, _) in enumerate(far)]
    return out


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


VECTORS = "vec_id long, embedding array<float>, label int, row string, `list` int"


def test_negatives_match_brute_force(spark, tmp_path):
    r = np.random.default_rng(3)
    middles = r.normal(0, 0.3, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + r.normal(0, 0.1, 8)], int(r.integers(0, 10))) for i in range(900)]
    copy = rows[100][1]
    rows += [(i, copy, i % 3) for i in range(900, 1200)]  # a large group of ties
    rows += [(1300, None, 1), (1301, [None] * 8, 1), (1302, [math.nan] * 8, 1), (1303, [math.inf] * 8, 2), (None, copy, 1), (1304, copy, None), (1400, copy, None)]
    rows += [(1500, [], 3), (1501, copy[:3], 3), (1600, copy[:5], 4), (200, rows[200][1], rows[200][2]), (7, rows[7][1], rows[7][2])]
    folder = written(spark, tmp_path, "embeddings", [(*x, "row", 9) for x in rows], VECTORS)
    got = [tuple(x) for x in hard_negatives.op11_hard_negatives(spark, folder).collect()]
    assert Counter(got) == Counter(plain_negatives(rows)) and len(got) > 300


@pytest.mark.parametrize("sizes", [{"bucket_rows": 40, "list_rows": 30}, {"bucket_rows": 5000, "sample": 3}])
def test_small_buckets_and_samples_change_nothing(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 5)], i % 4) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(x) for x in hard_negatives.mine(hard_negatives.relabelled(frame), every=25, **sizes).collect()]
    assert Counter(got) == Counter(plain_negatives(rows, 25))


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, [1.0], 1)], [(100, [1.0, 2.0], 1), (101, [1.0], 1)], [(1, [1.0], 1)], [(100, None, 1)], [(0, [], 0), (100, [], 0)]):
        got = hard_negatives.mine(hard_negatives.relabelled(spark.createDataFrame(rows, schema)))
        assert [tuple(x) for x in got.collect()] == plain_negatives(rows)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**40, 1.0]])
    assert hard_negatives.products(a, np.array([[2.0**20, 1.0], [2.0**40, 0.0]])).tolist() == [[2**60 + 1, 2**63 - 1]]


def test_bounds_hold_every_product():
    r = np.random.default_rng(1)
    rows = np.floor(r.normal(0, 60, (400, 6)))
    centres = hard_negatives.centroids(rows, 8)
    near, far = hard_negatives.nearest(rows, centres)
    lists = hard_negatives.Lists(centres, np.bincount(near, minlength=8), np.array([far[near == i].max(initial=0) for i in range(8)]), 16)
    least, most = lists.bounds(rows[:20])
    scores = rows[:20] @ rows.T
    assert (least[:, near] <= scores).all() and (scores <= most[:, near]).all()
    assert all(a + n <= b or m > 1 for (a, n), (b, m) in zip(zip(lists.first, lists.parts, strict=True), list(zip(lists.first, lists.parts, strict=True))[1:], strict=False) if n > 1)


# --- prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :] for c in own}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return [
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(n)).encode()).hexdigest())
        for n, m in members.items()
    ]


TURNS = "conv_id long, turn long, role string, text string, name string, depth int"


def test_trie_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    monkeypatch.setattr(prefix_trie, "TOGETHER", 2)
    r = random.Random(4)
    rows = []
    for c in [*range(60), 1000, 1003, 2001]:
        if c % 11 == 3:
            continue
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "bb"])) for t in range(r.randint(1, 14))]
    rows += [(70, t, "user", "same") for t in range(70)] + [(75, t, "user", "same") for t in range(69)] + [(75, 69, "user", "other")]
    rows += [(80, 1, "user", "tie")] * 3 + [(None, 1, "user", "lost"), (81, None, None, None)] + [(90, 0, "user", "long " * 20000)]
    folder = written(spark, tmp_path, "conversations", [(*x, "name", 5) for x in rows], TURNS)
    got = [tuple(x) for x in prefix_trie.op12_prefix_trie(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(plain_trie(rows), key=str)


def test_no_conversations_make_no_trie(spark):
    got = prefix_trie.trie(spark.createDataFrame([], TURNS))
    assert got.collect() == [] and got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_a_conversation_can_lose_all_turns(spark):
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "x"), (lone, 1, "user", "y")]
    got = [tuple(x) for x in prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert got == plain_trie(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_names_are_dense(spark):
    rows = spark.range(5000).selectExpr("id % 700 AS k", "id AS other").repartition(9)
    names = {(x.k % 700, x.name) for x in prefix_trie.named(rows.withColumn("kept", rows.k), ["k"]).selectExpr("kept AS k", "name").collect()}
    assert sorted(n for _, n in names) == list(range(700)) and len({k for k, _ in names}) == 700


# --- token counts


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "one two", "one two", "a <|endoftext|> b", "é " * 400, "word " * 600, "\x00\x01\x02", "x" * 3000, "日本語のテキスト", " \n\t ", "long text " * 30000]


def test_counts_are_the_library_s(spark, tmp_path, library):
    rows = [(i if i != 4 else None, t, "t", 1) for i, t in enumerate(TEXTS)] + [(0, "", "again", 2)]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string, n_tokens string, place int")
    got = [tuple(x) for x in token_counts.op13_token_counts(spark, folder).collect()]
    want = []
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 512))
    assert Counter(got) == Counter(want)


def test_only_new_texts_are_encoded(spark, tmp_path, monkeypatch):
    seen = []
    real = token_counts._counted
    monkeypatch.setattr(token_counts, "_counted", lambda misses, *a: seen.append(misses.count()) or real(misses, *a))
    cache = f"{tmp_path}/cache"
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    first = token_counts.count_tokens(docs, cache).collect()
    assert sorted(first) == sorted(token_counts.count_tokens(docs, cache).collect())
    more = docs.unionByName(spark.createDataFrame([(99, "another"), (100, None)], docs.schema))
    assert len(token_counts.count_tokens(more, cache).collect()) == 52
    assert seen == [7, 0, 2]
    # twice in the cache, as two jobs at once leave it: still one row a document
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(token_counts.count_tokens(docs, cache).collect()) == sorted(first)


def test_tokenizers_keep_their_counts_apart(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame(list(enumerate(TEXTS[:9])), "doc_id long, text string")
    cache = f"{tmp_path}/cache"
    by_bytes = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(docs, cache).collect()}
    by_pieces = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(docs, cache, path=path).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert by_pieces == {i: len(model.encode(t or "")) for i, t in enumerate(TEXTS[:9])} != by_bytes


def test_no_documents_no_counts(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(docs, f"{tmp_path}/cache").collect() == []


# --- row numbers


def test_numbers_tell_rows_of_any_origin_apart(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(20).selectExpr("id", "array(1, 2, 3) AS a").repartition(3).write.parquet(path)
    read = spark.read.parquet(path)
    for rows in (read, read.filter("id > 3").select("id"), read.selectExpr("id", "explode(a)"), read.union(read), read.crossJoin(read.limit(2).selectExpr("id AS other")), spark.read.parquet(path, path)):
        places = [str(x.place) for x in numbered(rows, "place").collect()]
        assert len(places) == len(set(places)) == rows.count()
