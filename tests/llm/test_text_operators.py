"""Decontamination, SimHash groups, language ID, quality and toxicity against plain versions and on odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from wayfold.llm import components, decontaminate, langid, quality, simhash, toxicity
from wayfold.llm.suffix_automaton import SuffixAutomaton

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


# --- suffix automaton


def test_automaton_matches_brute_force():
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(8)]
    a = SuffixAutomaton()
    for t in texts:
        a.add(t)
    query = "".join(r.choice("abcd") for _ in range(200))
    state = matched = 0
    for i, c in enumerate(query):
        state, matched = a.step(state, matched, c)
        assert matched == max(k for k in range(i + 2) if k == 0 or any(query[i + 1 - k : i + 1] in t for t in texts))


# --- decontamination


def plain_contamination(docs, items, window):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for key, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if key is None else str(key))
    out = []
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for i in range(len(w)):
            for n in range(1, window + 1):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 60])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    r = random.Random(2)
    word = lambda: r.choice(["a", "B", "cé", "d", "e-f", "7"])
    items = [(i, " ".join(word() for _ in range(r.randint(1, 9)))) for i in range(12)] + [(3, "same id"), (None, "no id here"), (20, None), (21, "..!")]
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "no id here"), (62, "no id here"), (None, "Same ID")]
    found = decontaminate.find_contamination(documents(spark, docs).withColumnRenamed("n_chars", "n_words"), spark.createDataFrame(items, "item_id long, text string"), window=4, keep=["doc_id"])
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.hit_items) for x in found.collect()), key=str) == sorted(plain_contamination(docs, items, 4), key=str)


def test_contamination_with_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.n_hit) for x in decontaminate.find_contamination(docs, items, keep=["doc_id"]).collect()] == [(3, 0)]
    assert decontaminate.find_contamination(documents(spark, []), items, keep=["doc_id"]).count() == 0


def test_spans_are_cut_or_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = documents(spark, [(1, f"before it, {item}. After it there are many more words than those of the item itself, so it stays"), (2, item), (3, "clean")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {x.doc_id: x.text for x in decontaminate.remove_contamination(docs, items, max_coverage=0.6).collect()}
    assert set(kept) == {1, 3} and kept[1].startswith("before it, \n. After") and "w3" not in kept[1]
    assert {x.doc_id for x in decontaminate.remove_contamination(docs, items).collect()} == {3}


# --- SimHash


def test_golay_keys_meet_within_three_bits():
    r = np.random.default_rng(3)
    a = r.integers(-(2**63), 2**63 - 1, 3000)
    for n in range(4):
        b = a.view(np.uint64).copy()
        for row in range(len(b)):
            for bit in r.choice(64, n, replace=False):
                b[row] ^= np.uint64(1) << np.uint64(bit)
        ka, kb = simhash.golay_keys(a), simhash.golay_keys(b.view(np.int64))
        assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def plain_groups(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i][1] ^ prints[j][1]) & (2**64 - 1)).count("1") <= simhash.LINK:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), key), key)
    return [least[find(i)] for i in range(len(prints))]


def test_groups_match_brute_force(spark):
    r = random.Random(4)
    prints = []
    for centre in [r.getrandbits(64) for _ in range(12)]:
        at = centre
        for _ in range(r.randint(1, 14)):  # chains that drift from their start, and exact copies
            for _ in range(r.randint(0, 4)):
                at ^= 1 << r.randrange(64)
            prints.append((len(prints), at - (1 << 64) if at >= 1 << 63 else at))
    found = {x.fp: x.root for x in simhash.group_fingerprints(spark.createDataFrame([(p,) for p in {p for _, p in prints}], "fp long")).collect()}
    groups = {}
    for (key, p), want in zip(prints, plain_groups(prints), strict=True):
        groups.setdefault(found.get(p, p), set()).add(want)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(plain_groups(prints)))


def test_near_duplicates_of_odd_texts(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base.upper()), (9, base + " x"), (1, None), (2, ""), (4, " \n"), (6, "one"), (7, "ONE"), (8, "one two"), (10, "other"), (10, "other"), (None, "alone")]
    found = simhash.near_duplicates(documents(spark, rows), words=3).collect()
    groups = {(x.doc_id, x.component_id) for x in found}
    assert len(found) == len(rows)
    assert {(3, 3), (5, 3), (1, 1), (2, 1), (4, 1), (6, 6), (7, 6), (8, 8), (10, 10), (None, None)} <= groups
    kept = simhash.keep_one(documents(spark, rows), words=3)
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in kept.collect()) == sorted({c if c is not None else -1 for _, c in groups})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_fingerprint_counts_bits_of_all_shingles():
    import xxhash

    words = [f"w{i}" for i in range(40)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(38)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(" \t".join(words).encode(), 3) & (2**64 - 1) == want


def test_components_by_contraction(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)] + [(200, x) for x in range(201, 240)]
    found = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 240), 200)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language ID


def plain_phrases(text, training):
    """Phrases of a greedy parse; a symbol that the training text lacks is a phrase."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and any(text[i : i + k + 1] in t for t in training):
            k += 1
        n, i = n + 1, i + k
    return n


def test_cross_parsing_matches_brute_force(monkeypatch):
    r = random.Random(5)
    samples = {"aa": ["the cat sat on the mat and the hat"], "bb": ["der hund und die katze"]}
    model = langid.Model(samples)
    trained = {k: [langid.symbols_of(t, model.codes).tobytes() for t in v] for k, v in samples.items()}
    texts = ["the cat and the hund", "qqq zzz", "die katze sat", "".join(r.choice("abcdehnrstu ") for _ in range(90))]
    symbols = [langid.symbols_of(t, model.codes) for t in texts]
    got = model.phrases(symbols)
    for i, s in enumerate(symbols):
        for j, language in enumerate(model.languages):
            assert got[i, j] == plain_phrases(s.tobytes(), trained[language])
    monkeypatch.setattr(langid, "STRIP", 16)
    assert (model.phrases(symbols) == got).all()


def test_strips_give_the_phrases_of_the_plain_parse(monkeypatch):
    r = random.Random(3)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    model = langid.Model({"a": [text(3000, "abcde ")], "b": [text(3000, "aabbcf ")], "c": ["abc" * 150]})
    symbols = [langid.symbols_of(t, model.codes) for t in [*(text(n, "abcdef ") for n in (0, 1, 5, 100, 3000)), "abc" * 1000, "a" * 2000]]
    monkeypatch.setattr(langid, "STRIP", 10**9)
    want = model.phrases(symbols)
    for strip in (16, 100, 999):
        monkeypatch.setattr(langid, "STRIP", strip)
        assert (model.phrases(symbols) == want).all()


LANGS = {"en": "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun", "de": "der schnelle braune fuchs springt über den faulen hund und schläft dann in der sonne"}


def test_languages_of_odd_texts(spark):
    rows = [(i, LANGS[k], k) for i, k in enumerate(["en", "de"] * 10)] + [(100, None), (101, "12 .,!"), (102, ""), (103, "the fox sleeps"), (104, "der hund schläft"), (104, "der hund schläft"), (None, "the dog", "xx"), (105, "日本語")]
    docs = documents(spark, rows)
    model = langid._model(docs)
    assert model.languages == ["de", "en"]
    got = [(x.doc_id, x.lang_pred) for x in langid.identify(docs.withColumnRenamed("n_chars", "score"), model).collect()]
    assert len(got) == len(rows) and {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (104, "de"), (None, "en")} <= set(got)
    assert dict(got)[105] in model.languages
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint({x.doc_id for x in kept.collect()}) and kept.count() == len(rows) - 3
    assert {x.lang_pred for x in langid.identify(docs, langid.Model({})).collect()} == {"und"}
    assert langid.accepted(documents(spark, [])).count() == 0


# --- labels


def labelled(spark, texts, label):
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(texts)])
    labels = spark.createDataFrame([(i, k) for i, (_, k) in enumerate(texts)] + [(None, 1), (10**9, 1), (0, None)], f"doc_id long, {label} int")
    return docs, labels


def test_toxic_words_are_found(spark):
    r = random.Random(6)
    syllables = "th en er on st in he ea nd ha re an ou ti".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    texts = []
    for i in range(200):
        words = [word() for _ in range(120)]
        if i % 4 == 0:
            for _ in range(5):
                words[r.randrange(120)] = r.choice(["idiot", "pathetic", "scum", "worthless"])
        texts.append((" ".join(words), int(i % 4 == 0)))
    docs, labels = labelled(spark, texts, "toxic")
    model = toxicity.learn(docs, labels, learnable=toxicity.fold(toxicity.F.col("doc_id"), 5) != 0)
    got = {x.doc_id: x.score for x in toxicity.add_scores(docs, model).collect()}
    right = sum((got[i] >= 0.5) == bool(k) for i, (_, k) in enumerate(texts))
    assert right >= 190
    odd = documents(spark, [(1, None), (2, ""), (3, "idiot " * 5000), (3, "!!")])
    scores = [x.score for x in toxicity.add_scores(odd, model).collect()]
    assert scores[0] == scores[1] == scores[3] and scores[2] > 0.99


def test_labels_of_long_texts_alone_are_learned(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PASSAGE_CHARS", 300)
    r = random.Random(16)
    word = lambda n: "".join(r.choice("aeioulmnrst") for _ in range(n))
    texts = [(" ".join(r.choice(["idiot", "scum"]) if i % 2 and r.random() < 0.3 else word(5) for _ in range(400)), i % 2) for i in range(60)]
    docs, labels = labelled(spark, texts, "toxic")
    rows, share = toxicity.sample_labelled(docs, labels, "toxic", toxicity.F.col("doc_id").isNotNull(), 50, 1000)
    found = rows.collect()
    assert len(found) >= 50 and all(len(x.text) == 300 and x.text in texts[x.doc_id][0] for x in found) and share == pytest.approx(31 / 61)


def plain_words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)


def test_words_are_terms(spark):
    r = random.Random(17)
    one, other = (["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)] for _ in range(2))
    texts = [(" ".join(r.choice(one if i % 2 else other) for _ in range(60)), i % 2) for i in range(120)]  # alike but for their words
    docs, labels = labelled(spark, texts, "quality")
    model = quality.learn(docs, labels, learnable=toxicity.fold(toxicity.F.col("doc_id"), 5) != 0)
    got = {x.doc_id: x.score for x in quality.add_scores(docs, model).collect()}
    assert sum((got[i] >= 0.5) == bool(k) for i, (_, k) in enumerate(texts)) >= 115
    for text in (b"", b"a", b"one Two one", "Größe größe 12 x".encode(), b"-- one,one;TWO\n", b"word " * 30000):
        counts = quality.word_counts(np.frombuffer(text, np.uint8))
        assert counts.sum() == pytest.approx(len(plain_words(text)), abs=len(text) // quality.PART)
        want = sum(quality.word_counts(np.frombuffer(w, np.uint8)) for w in plain_words(text)) if plain_words(text) else counts
        assert np.abs(counts - want).sum() <= 3 * (len(text) // quality.PART)


def test_scores_without_labels(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    learnable = toxicity.F.col("doc_id").isNotNull()
    assert {x.score for x in toxicity.add_scores(docs, toxicity.learn(docs, none, learnable=learnable)).collect()} == {0.0}
    assert {x.score for x in quality.add_scores(docs, quality.learn(docs, none, learnable=learnable)).collect()} == {0.0}


def test_quality_votes_match_brute_force(spark):
    r = random.Random(7)
    texts = [(" ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(40)), 1) for _ in range(60)] + [(" ".join(["SPAM!!"] * 40), 0), ("x### y$$$ " * 30, 0)] * 15
    docs, labels = labelled(spark, texts, "quality")
    model = quality.learn(docs, labels, learnable=quality.F.col("doc_id").isNotNull())
    got = [x.score for x in quality.add_scores(docs, model).orderBy("doc_id").collect()]
    assert all((s >= 0.3) == bool(k) for s, (_, k) in zip(got, texts, strict=True))
    v = quality.unit(quality.weighted(np.stack([quality.term_counts(t.encode()) for t, _ in texts[:5]])) * model.idf @ model.axes)
    for row, score in zip(v, got, strict=False):
        sims = model.known @ row
        near = np.argsort(-sims, kind="stable")[: quality.NEIGHBOURS]
        votes = np.maximum(sims[near], 0) ** quality.POWER * model.scale[near]
        assert score == pytest.approx(float((votes * model.labels[near]).sum() / votes.sum()), abs=0.05)
    odd = [x.score for x in quality.add_scores(documents(spark, [(1, None), (2, "a")]), model).collect()]
    assert odd[0] == odd[1] == pytest.approx(model.share)


def test_items_hash_is_of_sorted_ids(spark, tmp_path):
    (tmp_path / "x").mkdir()
    text = " ".join(f"w{i}" for i in range(10))
    documents(spark, [(1, text), (2, "clean")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, text), (10, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in decontaminate.op2_decontaminate(spark, str(tmp_path)).collect()}
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and got[1].n_items == 2 and got[1].contaminated
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest()


# --- near copies by shingles


def test_near_copies_by_similarity_match_brute_force(spark):
    from wayfold.llm import similar

    r = random.Random(13)
    rows = []
    for base in range(6):
        words = [f"b{base}w{r.randrange(200)}" for _ in range(150)]
        for copy in range(7):
            changed = list(words)
            for _ in range(copy):
                changed[r.randrange(150)] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  B"), (903, "A  B"), (None, rows[0][1] + " tail")]
    sets = [(k, set(similar.shingles((t or "").encode()).tolist())) for k, t in rows]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "row long, text string")
    found = {x.row: x.root for x in similar.groups(docs).collect()}
    near = lambda a, b: a and len(a & b) >= 0.8 * len(a | b)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i][1], sets[j][1]):
                parent[find(i)] = find(j)
    want = {}
    for i in range(len(sets)):
        want.setdefault(find(i), set()).add(i)
    got = {}
    for i in range(len(sets)):
        got.setdefault(found.get(i, i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", toxicity.F.lit(1)))
    assert {x.doc_id for x in kept.collect()} == {900, 901, 902} | {rows[min(g)][0] for g in want.values() if min(g) < 42}
    assert kept.columns == ["doc_id", "text", "row"] and similar.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_common_passage_makes_few_pairs_and_hides_no_near_copy(spark):
    from pyspark.sql import functions as F

    from wayfold.llm import similar

    r = random.Random(29)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join([passage, *(f"u{n}x{r.randrange(10**6)}" for _ in range(40))]) for n in range(300)]
    copies = [t + " tail" for t in texts[::100]]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "row long, text string")
    found = {}
    for x in similar.groups(docs).collect():
        found.setdefault(x.root, set()).add(x.row)
    assert sorted(map(sorted, found.values())) == [[0, 300], [100, 301], [200, 302]]

    sets = docs.select("row", F.lit(1).alias("one")).join(similar.append_columns(docs, ["text"], [similar.T.StructField("shingles", similar.T.ArrayType(similar.T.LongType()))], lambda: lambda b: [similar.pa.array([similar.shingles(t) for t in similar.utf8(b.column("text"))])], ["row"]), "row")
    nodes = sets.select(F.col("row").alias("node"), F.col("row").alias("root"), F.size("shingles").cast("long").alias("n"))
    rare = similar._rare_members(nodes, sets.drop("one"), 0.8).groupBy("key").count()
    assert rare.agg(F.max("count")).first()[0] <= 2


def test_near_copies_without_a_common_band_are_found(spark, monkeypatch):
    from wayfold.llm import similar

    rows = []
    for base in range(12):
        words = [f"b{base}w{i}" for i in range(104)]
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join([*words[:-8], *(f"new{base}x{i}" for i in range(8))]))]  # 92 of 108 shingles
    docs = spark.createDataFrame(rows, "row long, text string")
    monkeypatch.setattr(similar, "band_keys", lambda hashes: [int(np.bitwise_xor.reduce(hashes))] if len(hashes) else [])
    found = {}
    for x in similar.groups(docs).collect():
        found.setdefault(x.root, set()).add(x.row)
    assert sorted(map(sorted, found.values())) == [[2 * b, 2 * b + 1] for b in range(12)]


def test_prefixes_of_similar_sets_meet_in_any_order():
    from wayfold.llm import similar

    r = np.random.default_rng(17)
    for n in (1, 4, 5, 9, 10, 101):
        for _ in range(20):
            a = np.unique(r.integers(-(2**62), 2**62, n))
            lost = int(n * 0.2)
            b = np.unique(a[lost:])
            common = np.sort(r.choice(a, min(len(a), 3), replace=False))
            times = r.integers(2, 9, len(common))
            assert set(similar.first_of(a, common, times, 0.8).tolist()) & set(similar.first_of(b, common, times, 0.8).tolist())


def test_links_of_both_kinds_join_through_documents_that_go(spark, monkeypatch):
    import corpus_pipeline
    from wayfold.llm import similar

    words = [f"w{i}" for i in range(104)]
    b = " ".join(words)
    c = " ".join([*words[:-8], *(f"n{i}" for i in range(8))])  # 92 of 108 shingles
    rows = [(1, "quite another text, of words that the others lack"), (2, b), (3, c), (4, "alone"), (5, "alone"), (6, None), (7, "")]
    prints = {rows[0][1].encode(): 0x7F0003 << 32, b.encode(): 0x7F0007 << 32, c.encode(): 0xFFFF, b"alone": 0xFFFF << 20}
    monkeypatch.setattr(similar.simhash, "add_fingerprints", lambda docs, *, text, words, keep: docs.select(*keep, similar.F.udf(lambda x: prints.get((x or "").encode(), 0), "long")(text).alias("fingerprint_bits")))
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert sorted(x.doc_id for x in kept.collect()) == [1, 4, 6]


def test_long_texts_alone_teach_a_language_and_no_labels_keep_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 200)
    rows = [(i, "1. " * 100 + " ".join([LANGS[k]] * (1 if k == "en" else 9)), k) for i, k in enumerate(["en", "de"] * 10)]
    model = langid._model(documents(spark, rows))
    assert model.languages == ["de", "en"]
    got = {x.doc_id: x.lang_pred for x in langid.identify(documents(spark, [(1, "der hund schläft"), (2, "the fox sleeps")]), model).collect()}
    assert got == {1: "de", 2: "en"}
    unlabelled = documents(spark, [(1, LANGS["en"]), (2, "12 .,!"), (3, None), (4, "日本語")])
    assert {x.doc_id for x in langid.accepted(unlabelled).collect()} == {1, 4}
