"""Archives, media, token shards, site style trees, the mix and the pipeline: round trips and plain versions."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import curriculum, matroska, sitetree, tokens, warc
from wayfold.llm.common import work_path

PAGES = "page_id long, url string, html string"


# --- ARC and WARC


def test_arc_versions_and_declared_lengths():
    one = warc.version_block(1, "a.arc") + b"\n" + b"http://x/a b 1.2.3.4 20010203040506 text/html 5\nab\ncd\n\nhttp://y 0.0.0.0 200102030405 text/html 9\nshort"
    got = list(warc.arc_records(io.BufferedReader(io.BytesIO(one))))
    assert [(r["URL"], r["body"], r["truncated"], r["version"]) for r in got] == [("http://x/a b", b"ab\ncd", False, 1), ("http://y", b"short", True, 1)]
    two = warc.version_block(2, "b.arc") + warc.arc_record(2, 7, None, b"<p>") + b"\n"
    (record,) = warc.arc_records(io.BufferedReader(io.BytesIO(two)))
    assert record["Result-code"] == "200" and record["version"] == 2 and warc.split_http(record["body"])[1] == b"<p>" and record["URL"] == "about:blank"
    assert warc.warc_date("20010203") == "2001-02-03T00:00:00Z"


def test_conversion_round_trip(spark):
    big, bigger = "é" * 600, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [(1, "http://a/1", big), (5, "http://a/2", big), (3, "http://b", big), (2, None, "small"), (4, "u v", "small"), (6, "http://c", None), (7, "http://d", bigger), (8, "http://e", bigger), (8, "http://e", bigger), (None, "http://f", "x")]
    arcs, warcs = work_path(spark, "arc"), work_path(spark, "warc")
    warc.write_arc(spark.createDataFrame(rows, PAGES).repartition(3), arcs)
    warc.convert(spark, arcs, warcs)
    got = sorted(((x.key, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_warc(spark, warcs).collect()), key=str)
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        first = max((k for k, _, h in rows if h == html and k is not None), default=None) if len(raw) >= 1000 else key
        want.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == key else "revisit", None if first == key else first))
    assert got == sorted(want, key=str)
    assert all(x.sound for x in warc.read_warc(spark, warcs).collect())
    assert {x.arc_version for x in warc.read_arc(spark, arcs).collect()} == {1, 2}


def test_damaged_archives_give_rows_with_errors(spark, tmp_path):
    import gzip

    arc = b"http://ok 0.0.0.0 20010203040506 text/html 3\nabc\n"
    bad = b"short line\nanother\n" + b"http://x 0.0.0.0 20010203040506 text/html xx\n" + b"http://x 0.0.0.0 20010203040506 text/html -5\n"
    zipped = gzip.compress(warc.version_block(1, "z") + (arc * 4000))
    contents = {"a": warc.version_block(1, "a") + arc + bad + arc, "b": b"filedesc://b 0.0.0.0 20040101000000 text/plain 9\n1 0\n" + arc, "c": zipped[:-30], "d": b"", "e": warc.version_block(1, "e") + arc[:-3]}
    (tmp_path / "arc").mkdir()
    for name, raw in contents.items():
        (tmp_path / "arc" / f"part-{name}").write_bytes(raw)
    rows = warc.read_arc(spark, str(tmp_path / "arc")).collect()
    good, wrong = [r for r in rows if r.error is None], [r for r in rows if r.error is not None]
    assert {bytes(r.payload) for r in good} == {b"abc", b"a"} and sum(r.truncated for r in good) == 1 and len(good) > 3 and 3 <= len(wrong) <= 4
    assert all(r.url is None and bytes(r.payload) == b"" for r in wrong)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "from_arc"))
    assert warc.read_warc(spark, str(tmp_path / "from_arc")).filter("error IS NULL").count() == len(good)

    one = warc.warc_record([("WARC-Type", "response"), ("WARC-Record-ID", "<1>"), ("WARC-Date", "d"), ("WARC-Payload-Digest", warc._digest(hashlib.sha1(b"x").hexdigest()))], b"x") + b"\r\n\r\n"
    lacking = one.replace(b"WARC-Date: d\r\n", b"")
    files = {"a": one + b"junk\nmore\n" + one, "b": b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\n" + one, "c": one[:-8], "d": lacking + one.replace(b"sha1:", b"sha1:!") + one, "e": one.replace(b"response", b"metadata")}
    (tmp_path / "warc").mkdir()
    for name, raw in files.items():
        (tmp_path / "warc" / f"part-{name}").write_bytes(raw)
    rows = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sum(r.error is None for r in rows) == 4 and all(r.payload_bytes == 1 and r.sound for r in rows if r.error is None)
    assert len([r for r in rows if r.error]) >= 4


def test_empty_pages_give_empty_archives(spark):
    arcs, warcs = work_path(spark, "arc"), work_path(spark, "warc")
    warc.write_arc(spark.createDataFrame([], PAGES).repartition(1), arcs)
    warc.convert(spark, arcs, warcs)
    assert warc.read_warc(spark, warcs).count() == 0


# --- Matroska


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 512, 513, 4096, 4097, 70_000])
def test_media_round_trip(n):
    raw = bytes(random.Random(n).randrange(256) for _ in range(n))
    payload = matroska.padded(raw)
    data = matroska.write_pcm(payload)
    media = matroska.read(data)
    assert len(payload) % 64 == 0 and payload and matroska.payload_of(data, media) == payload
    assert data == matroska.write_pcm(payload) and {c[2] for c in media.cues} == set(media.clusters)
    times = [p[1] for p in media.packets]
    assert times == sorted(times) and media.codecs == {1: "A_PCM/INT/LIT"}


@pytest.mark.parametrize("lacing", matroska.LACINGS)
def test_lacings_and_unknown_sizes(lacing):
    frames = [b"a" * 300] if lacing == "none" else [b"a" * 300] * 3 if lacing == "fixed" else [b"a" * 300, b"b" * 255, b"c" * 7, b"d" * 900]
    block = matroska.simple_block(1, -5, frames, lacing)
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + matroska.number(matroska.CLUSTER_TIME, 20) + block
    data = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = matroska.read(data)
    assert [data[o : o + s] for _, _, o, s, _, _ in media.packets] == frames * 2 and media.packets[0][1] == 15_000_000 and len(media.clusters) == 2
    grouped = matroska.element(matroska.CLUSTER, matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x82\x00\x01\x00xyz")))
    assert matroska.read(matroska.element(matroska.SEGMENT, grouped)).packets[0][:2] == (2, 1_000_000)


def test_broken_media_is_an_error():
    data = matroska.write_pcm(bytes(64))
    with pytest.raises(ValueError):
        matroska.read(data[:-10])
    for n in (0, 1, 126, 127, 128, 16382, 16383, 1 << 40):
        assert matroska._read_vint(matroska.vint(n), 0)[:2] == (n, len(matroska.vint(n)))


def test_packet_table(spark):
    docs = spark.createDataFrame([(1, "x" * 2000), (2, None), (2, None)], "doc_id long, text string")
    files = matroska.add_media(docs, keep=["doc_id"])
    rows = matroska.add_packets(files, keep=["doc_id"]).select("doc_id", F.explode("packets").alias("p")).collect()
    assert sorted((r.doc_id, r.p.size) for r in rows) == [(1, 512)] * 4 + [(2, 64)] * 2
    assert matroska.add_packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().packets == []
    whole = matroska.write_pcm(bytes(640))
    damaged = matroska.add_packets(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate((whole, whole[:-5], b"\x00", b"text", b""))], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r.error is None for r in damaged][:3] == [True, False, False] and damaged[0].packets and not any(r.packets for r in damaged[1:])


# --- token shards


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_encoder_agrees_with_the_library(library):
    r, encoder = random.Random(8), tokens.Encoder(tokens.default_tokenizer())
    parts = ["a", "Z", "é", "ß", "'s", "'ll", "st", ".", ",", "!", "\n", "\t", " ", " ", "  ", "0", "9", "²", "½", "“", "—", "<|endoftext|>", "日", " ", "\x1c", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["word " * 300_000]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, code in zip(some, encoder.encode(some), strict=True):
            assert np.frombuffer(b"".join(code), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_plain_words_are_cut_together_and_recent_pieces_kept(library, monkeypatch):
    encoder, pattern, cut, asked = tokens.Encoder(tokens.default_tokenizer()), tokens.MARKED_PIECE, [], []
    given = encoder._library
    monkeypatch.setattr(tokens, "MARKED_PIECE", type("Counted", (), {"findall": lambda self, text: cut.append(text) or pattern.findall(text)})())
    monkeypatch.setattr(encoder, "_library", lambda pieces: asked.extend(pieces) or given(pieces))
    texts = ["one two, three... don't", "the word", "", "a", "two, word!'s x1", " led", "ends ", "ünd ßß— “q”", "new\nline", "the the two,' 12 ,"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoded = lambda some: [np.frombuffer(b"".join(c), "<u4").tolist() for c in encoder.encode(some)]
    assert encoded(texts) == want
    # a word with or without something after it, but a text's first, is no matter of the pattern
    assert not any(w in "".join(cut) for w in ("three", "ßß", " the")) and "don't" in "".join(cut)
    asked.clear()
    assert encoded(texts[::-1]) == want[::-1] and asked == []
    # a memory that is full begins anew
    encoder.pieces.most = 3
    assert encoded(texts) == want and asked and [encoded([t])[0] for t in texts] == want
    # where all units are plain, and where none is
    assert encoded(["only words here"])[0] == library.encode("only words here").ids and encoded(["", "1"])[1] == library.encode("1").ids


def test_re_pair_round_trip_and_random_access():
    r = np.random.default_rng(9)
    ids = np.concatenate([r.integers(0, 6, 20_000), np.tile([7, 8, 9, 9, 9], 500)]).astype(np.uint32)
    lengths = np.array([0, 5000, 1, 14_999, len(ids) - 20_000])
    raw = tokens.block_bytes(0, 0, [(i, False, int(n)) for i, n in enumerate(lengths)], ids, 50257)
    block = tokens.Block(memoryview(raw))
    assert (block.ids() == ids).all() and len(block.symbols) < 0.7 * len(ids) and block.counts.sum() == len(block.symbols)
    for start, stop in [(0, 1), (4999, 5003), (19_990, 20_050), (len(ids) - 3, len(ids)), (7, 7)]:
        assert (block.slice(start, stop) == ids[start:stop]).all()
    for a, b in block.rules.tolist():
        assert a != tokens.END


def test_re_pair_goes_on_to_the_end():
    ids = np.full(100_000, 7, np.uint32)
    symbols, counts, rules = tokens.pack(ids, np.array([len(ids)]), 50257)
    assert len(symbols) + len(rules) < 60 and counts.tolist() == [len(symbols)] and (tokens.expand(symbols, rules, 50257) == ids).all()
    ids = np.append(np.tile(np.arange(10, 74), 4000), tokens.END).astype(np.uint32)
    symbols, _, rules = tokens.pack(ids, np.array([len(ids)]), 50257)
    assert len(symbols) + len(rules) < 200 and (tokens.expand(symbols, rules, 50257) == ids).all()
    r = np.random.default_rng(3)
    for _ in range(30):
        docs = [np.append(r.choice([5, 5, 5, 6, 7, 8], r.integers(0, 60)), tokens.END) for _ in range(20)]
        ids = np.concatenate(docs).astype(np.uint32)
        symbols, counts, rules = tokens.pack(ids, np.array([len(d) for d in docs]), 50257, least=2)
        at = 0
        for d, n in zip(docs, counts.tolist(), strict=True):
            assert (tokens.expand(symbols[at : at + n], rules, 50257) == d).all()
            at += n
        left = [(a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist(), strict=False) if tokens.END not in (a, b) and a != b]
        assert len(left) == len(set(left))


@pytest.mark.parametrize("block", [tokens.BLOCK, 100])
def test_shards_round_trip(spark, library, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    monkeypatch.setattr(tokens, "LONG", 500)
    r = random.Random(10)
    rows = [(i * 7 % 50, " ".join(r.choice(["the", "cat", "été", "x1", "<|endoftext|>"]) for _ in range(r.randint(0, 200)))) for i in range(50)] + [(60, None), (61, ""), (None, "no id"), (5, "twice"), (62, "z" * 3000), (63, "# # #")]
    path = work_path(spark, "tokens")
    tokens.write_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")), path, tokens.default_tokenizer())
    got = tokens.read_shards(spark, path).orderBy("start").collect()
    assert len(got) == len(rows) and [x.doc_id is not None for x in got].index(True) == 1 and [x.doc_id for x in got[1:]] == sorted(x.doc_id for x in got[1:])
    want, at = {}, 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, tokens.END], "<u4")
        want.setdefault(key, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for x in got:
        assert x.start == at and (x.n_tokens, x.ids_crc32) in want[x.doc_id]
        at += x.n_tokens


def test_no_documents_give_no_tokens(spark):
    assert tokens.write_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- site style trees


def test_blocks_of_a_page():
    page = sitetree.Page(
        '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav>menu</nav><div class="ad x">buy</div><header>top</header><article><header><h1>A &amp; B</h1></header>'
        '<p>one<b>bold<br>two<p>three &lt;x&gt; <script>var a="</p>"</script><ul><li>i<li>j</ul><aside>no</aside><div id="comments"><p>hi</div><form><p>f</form><footer>by</footer></article><footer>foot'
    )
    assert page.main(set()) == "A & B\nonebold two\nthree <x>\ni\nj"
    assert sitetree.Page("plain <i>text</i> &copy; <!-- no").main(set()) == "plain text ©"
    assert sitetree.Page("<p>a<p>b<div>c</div>d").main(set()) == "a\nb\nc\nd"


def test_repeated_branches_go(spark):
    body = "<div class=x1><p>Same words on all pages</p></div><div class=body><p>Text {i} of page</p><p class=tail>Like and follow</p></div>"
    rows = [(i, f"http://h.example/{i}", body.format(i=i)) for i in range(20)]
    rows += [(100 + i, f"http://copies.example/{i}", body.format(i=1)) for i in range(20)] + [(200, "http://single.example/", body.format(i=9)), (201, None, None), (202, "x", ""), (203, None, "<p>a</p>"), (203, None, "<p>a</p>")]
    pages = spark.createDataFrame(rows, PAGES)
    got = {x.page_id: x.main_text for x in sitetree.extract(pages.withColumn("main_text", F.lit(1))).collect()}
    assert got[3] == "Text 3 of page"
    assert got[100].count("\n") == 2 and got[200].count("\n") == 2 and got[201] == got[202] == "" and got[203] == "a"
    assert sitetree.extract(pages).count() == len(rows)
    assert sitetree.extract(spark.createDataFrame([], PAGES)).count() == 0


# --- the mix


def plain_targets(sizes, weights=curriculum.WEIGHTS, share=curriculum.SHARE, repeats=curriculum.REPEATS):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in full]
        if not rest:
            return target
        level = left / sum(weight[n] for n in rest)
        over = [n for n in rest if level * weight[n] >= repeats * sizes[n]]
        if not over:
            return target | {n: level * weight[n] for n in rest}
        for n in over:
            full.add(n)
            target[n] = repeats * sizes[n]
            left -= target[n]


def test_mix_meets_its_targets(spark):
    r = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), None, r.choice(["a", "b", "c", "d", "é", None, "a", "a"])) for i in range(800)] + [(900, None, None, "empty"), (901, "x y", None, "b"), (901, "x y", None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("clash"))
    got = curriculum.plan_mix(docs).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, source_of = plain_targets(sizes), {r[0]: r[3] for r in rows}
    taken = {}
    for x in got:
        source = source_of[x.doc_id]
        assert x.target == pytest.approx(want[source]) and x.source_size == sizes[source] and x.taken <= 2 * x.size
        assert len(x.positions) * x.size == x.taken and all(0 <= p <= 1 for p in x.positions)
        taken[source] = taken.get(source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 31 for s in want)
    key = lambda x: (x.doc_id, x.taken, tuple(x.positions))
    assert sorted(map(key, got)) == sorted(map(key, curriculum.plan_mix(docs.repartition(7)).collect()))
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(x.positions) for x in got)
    assert curriculum.plan_mix(docs.limit(0)).count() == 0


def test_the_mix_has_each_planned_copy_once_whatever_the_rows_come_from(spark, tmp_path):
    from collections import Counter

    rows = [(i, " ".join(["w"] * (i % 9)), "en", "ab"[i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    for docs in (read, read.withColumn("lang", F.explode(F.array(*map(F.lit, "xyz")))), read.unionByName(read), read.join(read.select("doc_id").unionAll(read.select("doc_id")), "doc_id")):
        planned = curriculum.plan_mix(docs.withColumn("row", F.monotonically_increasing_id()), row="row").agg(F.sum(F.size("positions"))).first()[0]
        mixed = Counter(tuple(x) for x in curriculum.mix(docs).collect())
        given = Counter(tuple(x) for x in docs.collect())
        assert abs(sum(mixed.values()) - planned) <= 8 and all(n <= 2 * given[x] for x, n in mixed.items())


def test_due_times_invert_the_schedule(spark):
    for i, factors in enumerate(curriculum.SCHEDULES):
        rows = spark.range(101).select((F.col("id") / 100).alias("done"), F.lit(i).alias("rank"))
        for x in rows.select("done", curriculum.due_time(F.col("done"), F.col("rank")).alias("t")).collect():
            grid = np.linspace(0, x.t, 4001)
            area = np.trapezoid(np.interp(grid, np.linspace(0, 1, len(factors)), factors), grid)
            total = np.trapezoid(factors, np.linspace(0, 1, len(factors)))
            assert area / total == pytest.approx(x.done, abs=1e-6)


# --- the pipeline


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    r = random.Random(12)
    passage = " ".join(f"item{i}" for i in range(12))
    prose = lambda n: " ".join("".join(r.choice(["an", "the", "is", "on", "re"]) for _ in range(3)) for _ in range(n))
    rows = [(i, prose(60), "en", f"s{i % 3}", 1) for i in range(30)] + [(40, None, "en", "s0", 0), (41, "123", None, None, 3)]
    rows += [(50, rows[0][1], "en", "s1", 1), (51, prose(20) + " " + passage + " " + prose(20), "en", "s2", 1), (52, prose(50), None, None, 1), (52, prose(50), None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids.append({x.doc_id for x in docs.collect()})
    clean = set(range(30)) | {52}
    assert ids[0] == clean | {50, 51} and ids[1] == clean | {51} and ids[2] == clean and ids[3] <= clean
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count()


def test_gzip_files_are_read():
    data = gzip.compress(warc.version_block(1, "x") + warc.arc_record(1, 1, "http://x", b"y"))
    import pyarrow as pa

    assert len(list(warc.arc_records(warc._opened(pa.scalar(data, pa.binary()))))) == 1


def test_wrappers_named_for_furniture_keep_their_articles():
    from wayfold.llm.sitetree import Page

    article = "<article><p>The text of the article.</p></article>"
    text = "<div><p>" + "A long text that isn't in an article. " * 5 + "</p></div>"
    menu = "<div class='sidebar'><p>Menu of all.</p></div>"
    for wrapper in ("has-sidebar", "no-sidebar", "page-with-header", "search-result"):
        assert Page(f"<body><div class='{wrapper}'>{menu}{article}</div></body>").main(set()) == "The text of the article."
        assert Page(f"<body><span class='{wrapper}'>{article}</span>{menu}</body>").main(set()) == "The text of the article."
        assert Page(f"<body><div class='{wrapper}'>{menu}{text}</div></body>").main(set()).startswith("A long text")
    assert "Menu" not in Page(f"<body><div class='has-sidebar'>{menu}{text}</div></body>").main(set())
    comments = "<div class='comments'>" + "<article><p>A comment of some length on it.</p></article>" * 9 + "</div>"
    assert Page(f"<body>{article}{comments}</body>").main(set()) == "The text of the article."
    assert Page("<p>Read <span class='ad'>buy</span>on.</p>").main(set()) == "Read on."
    teasers = "<article><p>Read more.</p></article>" * 3
    assert Page(f"<body>{text}{teasers}</body>").main(set()).startswith("A long text")


def test_importance_is_that_of_plain_entropies(spark):
    import math
    import random
    from collections import Counter, defaultdict

    r = random.Random(2)
    rows = [(p, r.choice([1, 2]), n, r.choice([1, 2, 3]), sorted({r.randint(0, 9) for _ in range(r.randint(1, 4))}), 0, 0) for p in range(40) for n in range(4) if r.random() < 0.8] + [(99, 3, 7, 1, [1, 2], 0, 0)]
    got = {(x.host, x.node): (x.pages, x.importance) for x in sitetree.importance(spark.createDataFrame(rows, "page long, host long, node long, style long, units array<long>, root long, prior long")).collect()}
    styles, units, pages = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, host, node, style, found, *_ in rows:
        pages[host, node] += 1
        styles[host, node][style] += 1
        units[host, node].update(found)

    def surprise(counts, n):
        total = sum(counts.values())
        return 1.0 if n == 1 else 1 - sum(c / total * math.log(c) for c in counts.values()) / math.log(n)

    assert set(got) == set(pages)
    for key, n in pages.items():
        want = surprise(units[key], n) * (1 + surprise(styles[key], n)) / 2
        assert got[key][0] == n and got[key][1] == pytest.approx(want, abs=1e-12)


def test_pages_decide_and_priors_only_where_pages_are_few(spark, monkeypatch):
    words = "one two three four five six seven eight nine ten".split()
    text = lambda i: " ".join(words[(i * 7 + k) % 10] + str(i) for k in range(12))
    menu = lambda i: "".join(f"<li class='m{k}'>item {k if k else i}</li>" for k in range(6))
    page = lambda i, kind, repeated: f"<body><article><p>{text(i)}</p></article><div class='{kind}'><p>{'the same on all pages' if repeated else text(i + 500)}</p></div><div class='box'><ul>{menu(i)}</ul></div></body>"
    rows = [(i, "http://many/a", page(i, "plain", True)) for i in range(12)] + [(20 + i, "http://new/a", page(i, "promo", False)) for i in range(12)]
    rows += [(50, "http://alone/a", page(50, "promo", False)), (51, "http://single/a", page(51, "plain", False))]
    got = {x.page_id: x.main_text.split("\n") for x in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == [text(3)]  # no class word says so, but all pages repeat it, and the menu but for an item
    assert got[23] == [text(3), text(503)]  # called a promotion, but new on every page
    assert got[50] == [text(50), *(f"item {k if k else 50}" for k in range(6))]  # of one page, the word alone tells
    assert got[51][:2] == [text(51), text(551)]
