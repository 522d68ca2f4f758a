"""The n-gram join, decontamination, archives, URL filters and the pipeline against plain versions."""
import gzip
import io
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paytide.llm import decontam, ngram_join, toxicity, urlfilter, warc
from paytide.llm.queries import ORACLES, QUERIES


def _shingles(text):
    ws = text.encode().lower().split() if text else []
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def _components(rows):
    """Plain all-pairs components by id; rows of one id are one node."""
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def _corpus(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = list(rng.choice(vocabulary, 40))
    rows = []
    for _ in range(25):
        base = list(rng.choice(vocabulary, rng.integers(3, 120)))
        for _ in range(rng.integers(1, 7)):
            ws = base.copy()
            for _ in range(rng.integers(0, 4)):
                ws[rng.integers(len(ws))] = str(rng.choice(vocabulary))
            if rng.random() < 0.4:
                ws += shared[: rng.integers(5, 40)]
            rows.append((len(rows), " ".join(ws)))
    base = list(rng.choice(vocabulary, 60))
    for _ in range(60):  # a large group of near copies
        ws = base.copy()
        ws[rng.integers(len(ws))] = str(rng.choice(vocabulary))
        rows.append((len(rows), " ".join(ws)))
    rows += [(len(rows) + k, rows[-1][1]) for k in range(30)]  # and of exact ones
    return rows


@pytest.mark.parametrize("limit, long_run, salted", [(500_000, 2_000, 5_000), (600, 4, 3), (600, 2_000, 5_000)])
def test_join_equals_all_pairs(spark, limit, long_run, salted):
    rows = _corpus()
    want = _components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.join_components(docs, limit=limit, long_run=long_run, salted=salted).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(_shingles(rows[r["doc_id"]][1])) for r in got)


def test_near_copies_of_a_text_with_many_exact_copies(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(60)]
    rows += [(60 + k, " ".join([*base[:at], f"new{k}", *base[at + 1:]])) for k, at in enumerate((20, 150, 270))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.join_components(docs, salted=5).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {0}


def test_cells_of_one_large_group_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(200):  # variants of one text: linked by chains only
        ws = [f"w{k}" for k in range(100)]
        for at in rng.integers(100, size=i % 4):
            ws[at] = f"new{rng.integers(40)}"
        rows.append((i, " ".join(ws)))
    limit, largest, search_cells = 2_000, [], ngram_join.search_cells

    def watched(texts, members):
        cells = {}
        for r in members.select("cell", "id").distinct().collect():
            cells[r["cell"]] = cells.get(r["cell"], 0) + len(_shingles(rows[r["id"]][1]))
        largest.append(max(cells.values(), default=0))
        return search_cells(texts, members)

    monkeypatch.setattr(ngram_join, "search_cells", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for long_run in (2_000, 4):
        got = ngram_join.join_components(docs, limit=limit, long_run=long_run).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == _components(rows)
    assert max(largest) <= 2 * limit, largest


def test_join_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  b\tC"), (6, "a b c d"), (7, "x y z " * 3000), (8, "x y z " * 3001), (None, "a b c"),
            (9, "one two three four five six"), (9, "a b c"), (10, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "n", "label", "part", "component_id")})
    got = {}
    for r in ngram_join.join_components(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {**{i: {c} for i, c in _components(rows).items()}, None: {None}} or got[None] <= {None, 4}
    assert got[9] == got[10] == got[4] == {4} and got[1] == {1} and got[7] == got[8] == {7}
    assert ngram_join.join_components(docs.filter("false")).count() == 0


def test_search_is_exact_whatever_is_merged():
    rng = np.random.default_rng(5)
    base = [rng.choice(4000, 300, replace=False) for _ in range(4)]
    sets = []
    for k in range(60):
        s = base[k % 4].copy()
        s[: rng.integers(0, 60)] = rng.integers(4000, 9000)
        sets.append(np.unique(s).astype(np.uint64))
    up = list(range(len(sets)))
    for a, b in ngram_join.search(sets, np.arange(len(sets))):
        x, y = up[a], up[b]
        up = [x if u == y else u for u in up]
    plain = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                x, y = plain[i], plain[j]
                plain = [x if u == y else u for u in plain]
    same = lambda c: {frozenset(i for i in range(len(c)) if c[i] == v) for v in c}
    assert same(up) == same(plain)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 120] + [(5, 5), (3, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 if i <= 120 else 121 for i in range(201)}
    assert ngram_join.components(edges.filter("false")).count() == 0


def test_contamination(spark):
    item = " ".join(f"Item{i}" for i in range(40))
    items = spark.createDataFrame([(1, item), (2, None), (3, "one two three"), (None, item), (4, "")], "item_id long, text string")
    long = " ".join(f"filler{i}" for i in range(9000))
    rows = [(1, f"{long} {item.upper()}, {long}"), (2, None), (3, ""), (4, long), (5, " ".join(item.split()[:20])), (6, "one, TWO three"), (None, item), (7, item), (7, item),
            (8, " ".join(item.split()[:37]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "item", "digest", "h", "_k")})
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"]) for r in decontam.contaminated(docs, items).collect())
    assert got == [(-1, 1), (1, 1), (6, 3), (7, 1), (8, 1)]
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [2, 3, 4, 5]
    assert decontam.contaminated(docs.filter("false"), items).count() == 0 and decontam.clean(docs, items.filter("false")).count() == len(rows)


PAGES = [(1, "http://a.b/c?d", "x" * 500), (2, None, "x" * 500), (3, "u\r\nEvil: 1", None), (4, "http://é/ü", "é" * 40), (5, "", ""), (6, "http://t", "é" * 60), (7, "v", "é" * 60), (2, "again", "x" * 500),
         (None, "n", "x" * 500), (8, "small", "z" * 99), (9, "small", "z" * 99)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit(2))
    path = warc.archive(pages, str(tmp_path / "w"))
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archived_pages(spark, path).collect())
    assert got == [(-1, "revisit", 1, 500), (1, "response", None, 500), (2, "revisit", 1, 500), (2, "revisit", 1, 500), (3, "response", None, 0), (4, "response", None, 80),
                   (5, "response", None, 0), (6, "response", None, 120), (7, "revisit", 6, 120), (8, "response", None, 99), (9, "response", None, 99)]
    read = spark.read.format("warc").load(path)
    assert read.filter("target_uri = 'http://é/ü'").count() == 1 and read.filter("target_uri LIKE 'http%'").count() == 3
    assert read.filter("record_type = 'warcinfo'").count() >= 1
    assert bytes(read.filter("target_uri = 'http://é/ü'").first()["payload"]).decode() == "é" * 40
    assert warc.archived_pages(spark, warc.archive(pages.filter("false"), str(tmp_path / "none"))).count() == 0


def test_unwanted_payloads_are_not_decoded():
    one = warc.record("response", "<urn:a>", "http://a", None, "d", 9000, np.random.default_rng(1).bytes(9000))
    two = warc.record("revisit", "<urn:b>", "http://b", "<urn:a>", "d", 9000, None)
    first = bytearray(warc.member(one))
    first[-2000:-100] = bytes(1900)  # damage behind the headers
    stream = io.BytesIO(bytes(first) + warc.member(two))
    wanted = lambda h: h["warc-type"] == "revisit"
    assert [r.headers["warc-record-id"] for r in warc.records(stream, wanted, True)] == ["<urn:b>"]
    for data in (gzip.compress(one) + gzip.compress(two), one + two):  # members without lengths, and a plain archive
        got = list(warc.records(io.BytesIO(data), lambda h: True, True))
        assert [r.headers["warc-type"] for r in got] == ["response", "revisit"] and got[0].block.endswith(one[-100:-4])


def test_urls(spark):
    urls = ["http://Example.COM/en/71?x", "https://a.example.com/en/8", "http://com/en/", "x://example.net/de/8#f", "x://b.net/de/8", "noscheme/en/", None, "http://xcom/en/", "http://a.org", "http://a.org/es/x://b.net/de/", "://net/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("x"), "rule": F.lit(1)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.build(urlfilter.known_rules(spark), rows_per_segment=2)).collect()}
    assert got == {0: ("example.com", "/en/71", "example.com/en/7", "allow"), 1: ("a.example.com", "/en/8", "com/en/", "block"), 2: ("com", "/en/", "com/en/", "block"),
                   3: ("example.net", "/de/8", "example.net/de/8", "block"), 4: ("b.net", "/de/8", "net/de/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
                   7: ("xcom", "/en/", None, "allow"), 8: ("a.org", "", None, "allow"), 9: ("a.org", "/es/x://b.net/de/", "org/es/", "block"), 10: ("net", "/de/", "net/de/", "allow")}
    empty = urlfilter.build(urlfilter.known_rules(spark).filter("false"))
    assert {r["verdict"] for r in urlfilter.judge(pages, empty).collect()} == {"allow"} and urlfilter.judge(pages.filter("false"), empty).count() == 0


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "_key", lambda t: len(t))
    file = tmp_path / "s.bin"
    file.write_bytes(urlfilter._packed([(6, b"com/a/", 1), (6, b"net/a/", 0)]))
    digests = {"first": [6], "files": [str(file)], "tails": [3]}
    assert urlfilter.probe(["net", "com", "org"], ["/a/b", "/a/", "/a/"], digests) == (["net/a/", "com/a/", None], [0, 1, -1])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    from compare import compare, duck

    ok, note = compare(spark, duck(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name])
    assert ok, note


def _plain_toxic(chain, text):
    """The last probability of a chain, one feature after the other."""
    found = {chain.ids[f] for token in (text or "").lower().split() for f in toxicity.features(token) if f in chain.ids}
    p = []
    for w in chain.links:
        z = w[-1] + sum(w[c] for c in found) + sum(w[len(chain.ids) + k] * q for k, q in enumerate(p))
        p.append(1 / (1 + math.exp(-z)))
    return p[-1]


def test_planted_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    insults = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid"}
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = toxicity.judge(docs.filter(held), toxicity.fit(docs.filter(~held), labels)).collect()
    rude = [r for r in got if insults & set("".join(c if c.isalpha() else " " for c in r["text"].lower()).split())]
    assert len(rude) > 5 and sum(r["toxic"] for r in rude) >= 0.9 * len(rude)
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    assert sum(r["toxic"] for r in got if r["doc_id"] in clean) <= 1


def test_pipeline_stages_equal_plain_ones(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf}/benchmark.parquet')")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in out.collect()}
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k - 1}/*.parquet')" if k else f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        if name == "toxicity":
            chain = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert after == {i for i, t in before.items() if _plain_toxic(chain, t) < toxicity.THRESHOLD}
        elif name == "quality_rules":
            assert after == {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op7_quality_rules']}) WHERE kept").fetchall()}
        elif name == "ngram_join":
            assert after == {i for i, c in _components(list(before.items())).items() if i == c}
        elif name == "decontamination":
            assert after == before.keys() - {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op2_decontamination']})").fetchall()}
        else:
            assert after == before.keys()
        docs = out if k < 4 else docs
        assert k == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages_on_odd_documents(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "word " * 50, "en"), (3, "some words " * 30, "xx"), (3, "some words " * 30, "xx"), (4, "a b " * 40_000, "en")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long"), "kept": F.lit(0), "toxic": F.lit(0), "digest": F.lit(0), "_h": F.lit(0)})
    for docs in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "best_fit_packing" or out.columns == docs.columns
            assert out.count() <= docs.count() or name == "best_fit_packing"
