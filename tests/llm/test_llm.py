import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import langid, mixing, ngram_jaccard, ogg, packing, pii, sharding, simhash, toxicity, url_filter
from quarry.llm._graph import components
from quarry.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = ["token", "tokens", "p", "draw", "_draw", "rank", "_rank", "_n", "_gone", "c0", "shard", "line", "set_id", "part"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns of clashing names."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(40_000))
    rows = [(None, "a null id has words here", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 4), (4, "same words here again and again", "en", "s", 9), (5, "same words here again and again", "en", "s", 9), (4, "same words here again and again", "en", "s", 9), (6, long, "en", None, len(long)), (7, "x", None, "s", 1), (8, "é ü 漢字 \U0001f600 mail.7@example.com", "fr", "s", 5)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def nothing(spark, awkward):
    return awkward.limit(0)


ROWS = [("0", "calm words about a garden and a river"), ("1", "you idiot you stupid moron"), ("0", "the weather was fine all day"), ("1", "what a stupid idiot")] * 6


@pytest.fixture(scope="module")
def models():
    return {
        "tox": toxicity.fit_windows(ROWS),
        "lang": langid.fit([("en", "the cat and the dog went over there with them"), ("fr", "le chat et le chien sont dans la maison avec eux")] * 10),
        "mix": mixing.fit([("high", "calm words of a garden"), ("low", "BUY NOW!! BUY!! NOW!!")] * 10),
        "pii": pii.train(n=150),
    }


def operators(models):
    return {
        "toxicity": lambda d: toxicity.score(d, models["tox"]),
        "keep_clean": lambda d: toxicity.keep_clean(d, models["tox"]),
        "language": lambda d: langid.identify(d, models["lang"]),
        "sharding": lambda d: sharding.shard(d, shards=3, rounds=2),
        "pii": lambda d: pii.scan(d, models["pii"]),
        "redact": lambda d: pii.redact(d, models["pii"]),
        "ogg": lambda d: ogg.probe(ogg.from_documents(d)),
        "packing": lambda d: packing.pack(d, capacity=64),
        "rate": lambda d: mixing.rate(d, models["mix"]),
        "mix": lambda d: mixing.mix(d, models["mix"]),
        "jaccard": ngram_jaccard.join,
        "keep_one": ngram_jaccard.keep_one,
        "simhash": simhash.near,
    }


@pytest.mark.parametrize("name", ["toxicity", "keep_clean", "language", "sharding", "pii", "redact", "ogg", "packing", "rate", "mix", "jaccard", "keep_one", "simhash"])
def test_awkward_and_empty_tables(name, awkward, nothing, models):
    op = operators(models)[name]
    assert op(nothing).count() == 0
    out = op(awkward)
    rows = out.collect()
    if name in ("toxicity", "language", "sharding", "pii", "rate"):
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in awkward.select("doc_id").collect())
    if name in ("keep_clean", "redact", "mix", "keep_one"):
        assert out.columns == awkward.columns
    if name in ("keep_clean", "redact"):
        assert len(rows) == 10
    if name == "redact":
        (r,) = [r for r in rows if r.doc_id == 8]
        assert r.text.endswith("[EMAIL]") and r.n_chars == len(r.text) and {x.text for x in rows if x.doc_id == 1} == {None}
    if name == "keep_one":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    if name == "language":
        assert {r.doc_id: r.language for r in rows if r.doc_id in (1, 2, 7)} == {1: "und", 2: "und", 7: "und"}
    if name == "jaccard":
        assert sorted((str(r.doc_id), r.class_id, r.links, r.copies) for r in rows) == [("1", 1, 0, 0), ("2", 2, 0, 0), ("3", 3, 0, 0), ("4", 4, 0, 2), ("4", 4, 0, 2), ("5", 4, 0, 2), ("6", 6, 0, 0), ("7", 7, 0, 0), ("8", 8, 0, 0), ("None", None, 0, 0)]
    if name == "simhash":
        assert sorted((str(r.doc_id), r.class_id, r.links, r.copies) for r in rows) == [("1", 1, 0, 0), ("2", 2, 0, 0), ("3", 3, 0, 0), ("4", 4, 0, 2), ("4", 4, 0, 2), ("5", 4, 0, 2), ("6", 6, 0, 0), ("7", 7, 0, 0), ("8", 8, 0, 0), ("None", None, 0, 0)]
    if name == "ogg":
        assert not [r for r in rows if r.doc_id == 1] and len([r for r in rows if r.doc_id == 2]) == 2


def test_models_without_labels(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not toxicity.score(awkward, toxicity.train(awkward, labels)).where("toxic").count()
    assert {r.language for r in langid.identify(awkward, langid.train(awkward, labels)).collect()} == {"und"}
    assert {r.rate for r in mixing.rate(awkward, mixing.train(awkward, labels)).collect()} == {1.0}


def held_out(label, docs=SMALL.replace("0.001", "0.1")):
    import pyarrow.dataset as ds

    t = ds.dataset(f"{docs}/documents.parquet").to_table().to_pandas()
    m = t.merge(ds.dataset(f"{docs}/labels.parquet").to_table().to_pandas().drop_duplicates("doc_id"), on="doc_id")
    train = np.random.default_rng(0).random(len(m)) < 0.6
    rows = [(str(y), x) for y, x in zip(m[label][train], m.text[train], strict=True)]
    return rows, m[~train]


def test_toxicity_held_out_and_misspelt():
    rows, rest = held_out("toxic")
    model = toxicity.fit_windows(rows)
    score = toxicity._scorer(model, toxicity.WINDOW)
    got, want = score(pa.array(rest.text.tolist())) >= toxicity.THRESHOLD, rest.toxic.values == 1
    assert got[want].mean() > 0.8 and got[~want].mean() < 0.01
    assert (score(pa.array(["a quite idiotic stupidly written text of morons", "the fine day"])) > 0.5).tolist() == [True, False]


def test_every_pair_of_words_is_a_window(models):
    model, rng = models["tox"], random.Random(12)
    words = sorted({w for _, t in ROWS for w in t.split()})
    for n in (1, 2, 3, 9, 10):
        text = rng.sample(words, n)
        z = model.logits(pa.array([" ".join(text[k : k + 2]) for k in range(max(1, n - 1))]))
        odds = z[:, 1] - z[:, 0]
        best, place = model.margins(pa.array([" ".join(text)]), 2)
        assert best[0] == pytest.approx(odds.max()) and odds[place[0]] == pytest.approx(odds.max())


def test_language_held_out_and_calibrated():
    rows, rest = held_out("lang")
    model = langid.fit(rows)
    lang, p = model.predict(pa.array(rest.text.tolist()))
    assert (np.array(lang) == rest.lang.values).mean() > 0.99 and (p > 0).all() and (p <= 1).all()
    assert (model.folded != 0).mean() < 0.05  # L1 leaves few weights
    a, b = model.predict(pa.array(["the and of that"])), model.predict(pa.array(["the and of that"] * 3))
    assert a[1][0] == pytest.approx(b[1][2])


def test_language_scores_are_those_of_characters():
    """Against a plain reading of the definition: weights of the character n-grams, by their shares."""
    rows = [("en", "the cat and the dog went over there with them"), ("fr", "l'été où la forêt s'éveille après l'hiver")] * 10
    model = langid.fit(rows)
    texts = ["the été", "ñandú 漢字 \U0001f600", "", "x", "là-bas là-bas", "a" * 5000]

    def bucket(gram):
        key = 0
        for c in gram:
            key = (key * 0x01000193 + ord(c)) % 2**32
        return (((key * 0x9E3779B1) % 2**32 >> 16) ^ (len(gram) * 0x2B5)) % langid.BUCKETS

    z, n = model.logits(pa.array(texts))
    for t, got, many in zip(texts, z, n, strict=True):
        grams = [t[i : i + k] for k in langid.ORDERS for i in range(len(t) - k + 1)]
        assert many == len(grams)
        want = model.bias + sum((model.folded[bucket(g)].astype(float) for g in grams), np.zeros(2)) / max(1, len(grams))
        assert got == pytest.approx(want, abs=1e-5)


def test_sharding_keeps_sizes_and_cuts_less(spark):
    rng = random.Random(1)
    line = lambda g: f"this passage of group {g} is shared by all"
    docs = spark.createDataFrame([(i, f"{line(i % 12)}\nown words of {i} {rng.random()} go here too") for i in range(240)], "doc_id long, text string")
    edges = sharding.links(docs)
    # brute force: a star a shared line
    assert {(r.a, r.b, r.weight) for r in edges.collect()} == {(i % 12, i, 1) for i in range(12, 240)}
    got = sharding.shard(docs, shards=5, slack=0.1, rounds=10)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(sizes) == 240 and max(sizes) <= 53
    start = docs.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("shard"))
    assert sharding.cut(edges, got).first().cut < 0.6 * sharding.cut(edges, start).first().cut


def test_sharding_votes_of_all_neighbours(spark):
    rng = random.Random(10)
    line = lambda k: f"line {k} is shared by some documents"
    texts = {i: sorted({rng.randrange(8) for _ in range(3)}) for i in range(40)}
    docs = spark.createDataFrame([(i, "\n".join(map(line, x))) for i, x in texts.items()], "doc_id long, text string")
    at = spark.createDataFrame([(i, i % 3) for i in texts], "doc_id long, shard int")
    want = {i: [sum(len(set(x) & set(y)) for j, y in texts.items() if j != i and j % 3 == k) for k in range(3)] for i, x in texts.items()}
    rows = sharding.shared_lines(docs)
    assert {r.doc_id: r.votes for r in sharding.votes(rows, at, 3).collect()} == want
    cut = sharding.line_cut(rows, at).first()
    assert (cut.links, cut.cut) == (sum(map(sum, want.values())) // 2, sum(w[k] for i, w in want.items() for k in range(3) if k != i % 3) // 2)


def test_fill_is_even():
    rng = random.Random(11)
    for _ in range(100):
        sizes, rest = [rng.randint(0, 9) for _ in range(4)], rng.randint(0, 20)
        want = list(sizes)
        for _ in range(rest):
            want[want.index(min(want))] += 1
        got = sharding.fill(sizes, rest)
        assert min(got) >= 0 and sum(got) == rest and sorted(n + x for n, x in zip(sizes, got, strict=True)) == sorted(want)


def test_sharding_gathers_documents_apart_from_a_lines_least(spark):
    """One line's group is greater than a shard; its documents still come together, not only beside its least one."""
    docs = spark.createDataFrame([(i, "a line that very many documents share" if i < 60 else f"own words of {i} go here too") for i in range(150)], "doc_id long, text string")
    sizes = sorted(r["count"] for r in sharding.shard(docs, shards=5, slack=0.1, rounds=10).where("doc_id < 60").groupBy("shard").count().collect())
    assert sum(sizes) == 60 and sum(n * (n - 1) // 2 for n in sizes) > 0.4 * 60 * 59 / 2
    # spread evenly it would be 0.19, and at most 0.49 with shards of 33


def test_quotas_never_overfill():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(0, 50) for _ in range(4)]
        capacity = max(sizes) + rng.randint(0, 5)
        wishes = {(i, j): rng.randint(0, 20) for i in range(4) for j in range(4) if i != j}
        got = sharding.quotas(wishes, sizes, capacity)
        after = [sizes[k] + sum(n for (_, j), n in got.items() if j == k) - sum(n for (i, _), n in got.items() if i == k) for k in range(4)]
        assert all(0 <= n <= wishes[k] for k, n in got.items()) and max(after) <= capacity


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(20)] + [(None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_url_decisions_reach_aliases(spark):
    canonical = '<head><link href="https://spam-farm.example.org/x" rel="canonical"></head>'
    rows = [(1, "http://www.good.org/a", None), (2, "https://mirror.net/copy", canonical), (3, "https://short.ly/1", None), (4, "https://ok.org/about", "<meta http-equiv=refresh content='0; url=/cart'>"), (5, "https://ok.org/cart/", ""), (6, None, "x"), (None, "", None), (8, "https://M.good.org/a.html?utm_source=x#t", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("component", F.lit(2))
    redirects = spark.createDataFrame([("https://short.ly/1", "https://mirror.net/copy"), ("https://short.ly/1", None)], "f string, t string")
    got = {r.page_id: r for r in url_filter.decide(pages, redirects).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "none", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "none", None: "none", 8: "none"}
    assert got[3].direct == "none" and got[5].direct == "block" and got[1].canonical == got[8].canonical == "good.org/a"
    assert url_filter.decide(pages.limit(0)).count() == 0


def test_url_edges_of_every_form(spark):
    link = lambda to: f"<LINK href='{to}' rel=canonical>"
    want = {"https://a.org/x/y.html": {"q.html": "a.org/x/q", "../z/": "a.org/z", "?p=2&amp;q=1": "a.org/x/y.html?p=2&q=1", "//b.org/u": "b.org/u", "/v?utm_source=f": "a.org/v", "http://www.c.org/w/index.html": "c.org/w"}}
    for url, targets in want.items():
        pages = spark.createDataFrame([(k, url, link(t)) for k, t in enumerate(targets)], "page_id long, url string, html string")
        got = {r.b for r in url_filter.declared(pages).collect()}
        assert got == {v.replace("y.html?", "y?") for v in targets.values()}
    pages = spark.createDataFrame([(1, "https://a.org/l?page=2", None), (2, "https://a.org/l/", None), (2, "https://a.org/l/", None), (3, "https://b.org/cart?x=1", "y" * 300_000), (4, "https://b.org/cart?x=2", None)], "page_id long, url string, html string")
    rows = sorted(tuple(r) for r in url_filter.decide(pages, url_filter.paginated(pages)).select("page_id", "canonical", "verdict").collect())
    assert rows == [(1, "a.org/l", "none"), (2, "a.org/l", "none"), (2, "a.org/l", "none"), (3, "b.org/cart", "block"), (4, "b.org/cart", "block")]


def test_url_query_has_components(spark):
    rows = QUERIES["op4_url_filter"](spark, SMALL).collect()
    assert sum(url_filter_node(r.url) != r.canonical for r in rows) > 0


def url_filter_node(url):
    """The normal form, by hand."""
    import re

    u = re.sub(r"#.*$", "", url.strip())
    u = re.sub(r"(?i)([?&])(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&#]*", r"\1", u)
    u = re.sub(r"([?&])&+", r"\1", re.sub(r"[?&]+$", "", u))
    host, path, query = re.match(r"[a-z]+://([^/?]*)([^?]*)(.*)$", u).groups()
    return re.sub(r"^(www|m)\.", "", re.sub(r":(80|443)$", "", host.lower())) + re.sub(r"(/index)?(\.html?)?/*$", "", path) + query


def test_crf_marginals_are_exact_on_trees_and_close_on_loops(models):
    m = models["pii"]
    for text, tolerance in (("call +1 (212) 555-1234 now at 12:30", 1e-6), ("a 12345678 b 12345678 c 99 12345678 77", 0.05)):
        g, _, _ = pii.graph(pa.array([text]))
        own, n, k = m.scores(g), len(g.row), len(pii.LABELS)
        total = np.full((n, k), -np.inf)
        for y in itertools.product(range(k), repeat=n):
            s = sum(own[i, y[i]] for i in range(n)) + sum(m.pair[e][y[a], y[b]] for e in ("chain", "same", "alike") for a, b in getattr(g, e))
            for i in range(n):
                total[i, y[i]] = np.logaddexp(total[i, y[i]], s)
        want = np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])
        assert np.abs(np.exp(m.marginals(g)) - want).max() < tolerance


def test_pii_held_out_and_consistent(trained_pii):
    m = trained_pii
    texts, spans = pii.training_set(150, seed=77)
    g, _, offsets = pii.graph(pa.array(texts))
    whole, _, offsets = pii.graph(pa.array(texts), everything=True)
    y, z = pii.truth(whole, offsets, spans), m.label(whole)
    assert (z[y > 0] == y[y > 0]).mean() > 0.97 and (y[z > 0] == z[z > 0]).mean() > 0.97
    # what is left out of message passing is outside in the whole field too
    some = np.zeros(len(z), int)
    some[g.place] = m.label(g)
    assert len(g.row) < 0.5 * len(z) and (some == z).mean() > 0.999 and (y[np.setdiff1d(np.arange(len(y)), g.place)] > 0).sum() <= 0.01 * (y > 0).sum()
    assert (m.label(g) == m.marginals(g).argmax(1)).mean() > 0.999
    # the second place has no context of its own: the first decides
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    found, _ = pii.entities(m, pa.array([f'token = "{key}" and ' + "plain words " * 300 + f"then {key} again"]))
    assert [k for *_, k in found[0]] == ["SECRET", "SECRET"]
    clean, _ = pii.entities(m, pa.array(["In 2019 about 35 % of 1,200 people (page 12) used version 2.0 at 10:30", "Licensed under the Apache License, Version 2.0."]))
    assert clean == [[], []]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("password = correcthorsebatterystaple", [("correcthorsebatterystaple", "SECRET")]),
        ('set token = "ABCdefGHIjklMNOpqrSTUvwx" here', [("ABCdefGHIjklMNOpqrSTUvwx", "SECRET")]),
        ("My name is John Smith and Smith lives here. Later on John went home", [("John Smith", "NAME"), ("Smith", "NAME"), ("John", "NAME")]),
        ("a ssn 123-45-6789 is given", [("123-45-6789", "SSN")]),
        ("pay to DE89370400440532013000 now", [("DE89370400440532013000", "IBAN")]),
        ("IBAN GB29 NWBK 6016 1331 9268 19 please", [("GB29 NWBK 6016 1331 9268 19", "IBAN")]),
        ("card 4111 1111 1111 1111 ok", [("4111 1111 1111 1111", "CARD")]),
        ("number 4111111111111111 here", [("4111111111111111", "CARD")]),
        ("number 4111111111111112 has a wrong sum", []),
        ("write to jane_doe@mail.example.org or call (212) 555-0199 today", [("jane_doe@mail.example.org", "EMAIL"), ("(212) 555-0199", "PHONE")]),
        ("the host 10.20.30.40 is up, version 1.2.3.4.5 is not", [("10.20.30.40", "IP")]),
        ("the token bucket algorithm is a key idea and the password was lost", []),
        ("commit 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 on 2024-05-06 at 10:30", []),
    ],
)
def test_pii_by_hand(trained_pii, text, want):
    found, _ = pii.entities(trained_pii, pa.array([text]))
    assert [(text.encode()[a:b].decode(), k) for a, b, k in found[0]] == want


@pytest.fixture(scope="module")
def trained_pii():
    return pii.train()


def test_pii_finds_what_patterns_find(trained_pii):
    """Of numbers of 16 digits those whose check sum holds are cards; the others are left alone."""
    import re

    import pyarrow.dataset as ds

    texts = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().column("text").to_pylist()
    pats = {"EMAIL": r'[^\s@"<>]+@[a-z0-9.-]+\.[a-z]{2,}', "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}", "IP": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "CARD": r"\b\d{16}\b", "SECRET": r'(?<=token = ")[0-9a-f]{40}(?=")'}
    found, _ = pii.entities(trained_pii, pa.array(texts))
    lacking, clean, touched = [], 0, 0
    for t, spans in zip(texts, found, strict=True):
        b = t.encode()
        want = {(v, k) for k, p in pats.items() for v in re.findall(p, t) if k != "CARD" or pii._luhn(v.encode())}
        lacking += want - {(b[x:y].decode(), k) for x, y, k in spans}
        clean, touched = clean + (not want), touched + (bool(spans) and not want)
    assert not lacking and touched <= 0.005 * clean


def stream_of(packets, page=300, serial=9):
    return ogg.write_stream(serial, packets, [100 * (k + 1) for k in range(len(packets))], 1, page)


def test_ogg_round_trip_and_damage():
    rng = random.Random(4)
    packets = [rng.randbytes(n) for n in (30, 0, 255, 254, 256, 510, 5000, 1, 70_000, 3)]
    pages = stream_of(packets)
    other = ogg.vorbis(2, [b"abc"] * 50)
    streams, bad, skipped = ogg.demultiplex(ogg.multiplex(pages, other))
    assert [s.packets for s in streams][0] == packets and bad == skipped == 0 and all(s.ended and not s.gaps and not s.torn for s in streams)
    # published check value: CRC-32 of this polynomial, unreflected, from nought
    assert ogg.checksum(b"123456789") == 0x89A1897F
    data = bytearray(b"".join(pages))
    hit = len(pages[0]) + len(pages[1]) + 40
    data[hit] ^= 1
    (s,), bad, skipped = ogg.demultiplex(bytes(data) + b"junk")
    assert bad == 1 and s.gaps == 1 and skipped == len(pages[2]) + 4 and all(p in packets for p in s.packets) and len(s.packets) < len(packets)
    assert ogg.rows(b"")[0][1] == "none" and ogg.rows(b"OggS")[0][-1] == 4
    assert ogg.seconds(312 + 48000, 48000.0, 312, 0) == 1.0 and ogg.seconds((5 << 6) | 3, 4.0, 0, 6) == 2.0 and ogg.seconds(9, 0.0, 0, 0) is None


def read_ogg(data):
    """An independent reader: no checksums, whole files only; serial -> packets and (packets so far, granule)."""
    crc = [0] * 256
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        crc[i] = c & 0xFFFFFFFF
    streams, at = {}, 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS"
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        c = 0
        for k, v in enumerate(data[at:end]):
            c = ((c << 8) & 0xFFFFFFFF) ^ crc[(c >> 24) ^ (0 if 22 <= k < 26 else v)]
        assert c == int.from_bytes(data[at + 22 : at + 26], "little")
        packets, held, ends = streams.setdefault(int.from_bytes(data[at + 14 : at + 18], "little"), ([], [], []))
        body = at + 27 + n
        for v in data[at + 27 : at + 27 + n]:
            held.append(data[body : body + v])
            body += v
            if v < 255:
                packets.append(b"".join(held))
                held.clear()
        granule = int.from_bytes(data[at + 6 : at + 14], "little", signed=True)
        if granule != -1:
            ends.append((len(packets), granule))
        at = end
    return {k: (p, e) for k, (p, _, e) in streams.items()}


def test_ogg_query_gives_the_texts_back(spark):
    import hashlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    files = {r.doc_id: read_ogg(r.media) for r in ogg.from_documents(docs).limit(40).collect()}
    rows = {(r.doc_id, r.serial): r for r in QUERIES["op6_ogg"](spark, SMALL).collect()}
    for k, t in texts.items():
        r = rows[k, 1]
        lines = t.encode().split(b"\n")
        assert r.payload_md5 == hashlib.md5(b"".join(b"\xf8" + x for x in lines)).hexdigest() and r.packets == len(lines)
        assert r.packet_s == pytest.approx([0.02 * (n + 1) for n in range(len(lines))]) and r.first_s == pytest.approx(0.02) and r.last_s == pytest.approx(0.02 * len(lines))
    for k, streams in files.items():
        for serial, headers, scale in ((1, 2, lambda g: (g - 312) / 48000), (2, 3, lambda g: g / 44100)):
            packets, ends = streams[serial]
            r = rows[k, serial]
            assert r.payload_md5 == hashlib.md5(b"".join(packets[headers:])).hexdigest()
            assert all(r.packet_s[n - 1 - headers] == pytest.approx(scale(g)) for n, g in ends if n > headers)


def test_ogg_times_of_packets():
    sizes = [0xF8, 0xF9, 0xFB]  # 20 ms; two frames; as many as the next byte tells
    assert [ogg.opus_samples(bytes([b, 3])) for b in sizes] == [960, 1920, 2880] and ogg.opus_samples(b"") == 0
    assert ogg.opus_samples(b"\x00") == 480 and ogg.opus_samples(b"\x18") == 2880 and ogg.opus_samples(b"\x60") == 480 and ogg.opus_samples(b"\x80") == 120
    data = b"".join(ogg.opus(5, [b"x" * 900] * 12))
    (row,) = ogg.rows(data)
    assert row[10] == pytest.approx([0.02 * k for k in range(1, 13)])
    # a lost page: packets after it keep their times, since pages tell them
    pages = ogg.opus(5, [b"x" * 900] * 40)
    (row,) = ogg.rows(b"".join(pages[:4] + pages[5:]))
    assert row[5] == 1 and row[7] >= 1 and row[10][-1] == pytest.approx(0.8) and sorted(row[10]) == row[10]


def optimum(sizes, capacity):
    """Fewest sequences, by trying every set for the largest item."""
    if not sizes:
        return 0
    w, rest = sizes[0], sizes[1:]
    best = len(sizes)
    for n in range(len(rest) + 1):
        for chosen in itertools.combinations(range(len(rest)), n):
            if w + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(120):
        capacity = rng.choice([10, 17, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 7))), reverse=True)
        counts = {w: sizes.count(w) for w in sizes}
        left = packing._Sizes(counts)
        fixed = packing.reduce(left, capacity)
        rest = sorted((w for w, n in left.count.items() for _ in range(n)), reverse=True)
        assert all(sum(s) <= capacity for _, s in fixed)
        assert sum(n for n, _ in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([20, 100])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 120))), reverse=True)
        rooms = []
        for w in sizes:
            fit = [r for r in rooms if r >= w]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - w)
            else:
                rooms.append(capacity - w)
        got = packing.best_fit(packing._Sizes({w: sizes.count(w) for w in sizes}), capacity)
        assert sum(n for n, _ in got) == len(rooms) and sorted(w for n, s in got for _ in range(n) for w in s) == sizes[::-1]


def test_packing_query_is_a_packing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = QUERIES["op7_packing"](spark, SMALL).collect()
    used, tokens = {}, {}
    for r in rows:
        used.setdefault(r.sequence, []).append((r.start, r.start + r.tokens))
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.tokens
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert tokens == {r.doc_id: max(1, len(r.text) // 4) for r in docs.collect()}
    assert sorted(used) == list(range(len(used))) and len(used) <= 1.05 * sum(tokens.values()) / packing.CAPACITY + 1


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    t = rng.integers(1, 500, 80)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>")
    target = np.array([0.7, 0.2, 0.1])
    steps, momentum, got = mixing.fit_rates(df, 3, target)
    x, _ = mixing.rates_of(p, steps, momentum)
    start = p.T @ t
    assert (x >= 0).all() and np.allclose(p.T @ (t * x), got)
    y = np.ones(80)  # brute force: plain projected gradient, very long
    for _ in range(20_000):
        y = np.maximum(0, y - p @ ((p.T @ (t * y) - target * start.sum()) / start))
    loss = lambda r: (((p.T @ (t * r)) - target * start.sum()) ** 2 / start).sum()
    assert loss(x) <= loss(y) + 1e-4 * start.sum() and np.abs(got - target * start.sum()).max() <= 2e-4 * start.sum()


def test_mix_copies_follow_the_rates(spark, models):
    rows = [(k, "calm words of a garden" if k % 2 else "BUY NOW!! BUY!! NOW!!") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rate = {r.doc_id: r for r in mixing.rate(docs, models["mix"], {"high": 0.8, "low": 0.2}).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mix(docs, models["mix"], {"high": 0.8, "low": 0.2}).groupBy("doc_id").count().collect()}
    assert got == {k: r.copies for k, r in rate.items() if r.copies}
    high = sum(r.tokens * r.copies for k, r in rate.items() if k % 2)
    assert 0.7 < high / sum(r.tokens * r.copies for r in rate.values()) < 0.9
    with pytest.raises(ValueError, match="no domain"):
        mixing.rate(docs, models["mix"], {"other": 1.0})


def word_sets(docs):
    import re

    out = {}
    for r in docs:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", (r.text or "").lower())
        g = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) or frozenset([tuple(w)] if w else [])
        if g:
            out.setdefault(g, []).append(r.doc_id)
    return {g: tuple(sorted(x)) for g, x in out.items()}


def brute(sets):
    """Pairs of similar sets as pairs of their documents; for each document its class, links and copies."""
    pairs = {tuple(sorted((x, y))) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if a & b and len(a & b) >= 0.6 * len(a | b) - 1e-9}
    parent = {i: i for x in sets.values() for i in x}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(sets.values(), 0)
    for x, y in pairs:
        links[x], links[y] = links[x] + 1, links[y] + 1
    for i, j in [(x[0], y[0]) for x, y in pairs] + [(x[0], i) for x in sets.values() for i in x]:
        i, j = sorted((find(i), find(j)))
        parent[j] = i
    return pairs, {i: (find(i), links[x], len(x) - 1) for x in sets.values() for i in x}


def found(df):
    return {r.doc_id: (r.class_id, r.links, r.copies) for r in df.collect()}


def pairs_of(df, docs):
    """The pairs of ``similar`` as pairs of documents."""
    own = {}
    for r in ngram_jaccard._members(docs, 3).collect():
        own.setdefault(r.set_id, []).append(r.doc_id)
    rows = [tuple(sorted((tuple(sorted(own[r.a])), tuple(sorted(own[r.b]))))) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_jaccard_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    pairs, want = brute(word_sets(rows))
    assert pairs and pairs_of(ngram_jaccard.similar(docs), docs) == pairs
    assert found(QUERIES["op9_ngram_jaccard"](spark, SMALL)) == {r.doc_id: want.get(r.doc_id, (r.doc_id, 0, 0)) for r in rows}
    kept = sorted(r.doc_id for r in ngram_jaccard.keep_one(docs).select("doc_id").collect())
    assert kept == [r.doc_id for r in rows if want.get(r.doc_id, (r.doc_id,))[0] == r.doc_id]


def test_hot_tokens_lose_nothing(spark):
    """A passage against the same passage and a rarer, but also hot one: the prefixes share few tokens, all of them hot. With any number of orders, and where a token's sets are dealt into blocks."""
    docs = []
    for g in range(6):
        first, second = ([f"w{g}x{k}y{p}" for k in range(n)] for p, n in enumerate((100, 56)))
        texts = [first + (second if k % 2 else []) for k in range(24)] + [first[5 * k :] for k in range(1, 12)]  # the passage's beginning is rarer than its end
        docs += [" ".join([*w, f"n{g}x{k}"]) for k, w in enumerate(texts)]
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(60):  # many near copies share all their tokens
        w = list(base)
        for _ in range(6):
            w[rng.randrange(300)] = f"n{rng.random()}"
        docs.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    pairs, want = brute(word_sets(df.collect()))
    assert len(pairs) > 6 * 12 * 12 + 60 * 59 // 2 - 40
    for orders, block in ((3, 4096), (2, 7), (1, 4096)):
        assert pairs_of(ngram_jaccard.similar(df, orders=orders, hot_df=5, block=block), df) == pairs
    assert found(ngram_jaccard.join(df, hot_df=5, block=11)) == want


class Plan:
    """Stands for a table, and gives the functions that would run over it."""

    def select(self, *_):
        return self

    where = groupBy = select

    def mapInArrow(self, run, _):
        return run

    applyInArrow = mapInArrow


def test_jaccard_worker_memory(spark, monkeypatch):
    """A task's Python holds about its batch: 2 million tokens of 8 bytes, not a multiple that adds up beside an executor's heap."""
    import tracemalloc

    monkeypatch.setattr(ngram_jaccard, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)}))}))
    texts = [" ".join(f"w{(k * 7919 + j * j) % 99991}" for j in range(1000)) for k in range(2100)]
    run = ngram_jaccard._post(Plan(), 3, 600)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 600 and peak < 90e6, peak


def test_jaccard_postings_cost_their_bits(spark, monkeypatch):
    """A token's offset in one of 195 ranges is 41 bits, not 6 bytes, and reads back as it was."""
    monkeypatch.setattr(ngram_jaccard, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)}))}))
    texts = [" ".join(f"w{k}x{j}" for j in range(1002)) for k in range(40)]
    (b,) = ngram_jaccard._post(Plan(), 3, 195)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])
    assert sum(len(x or b"") for x in b.column("tokens").to_pylist()) < 40_000 * 41 / 8 + 195
    for bits in (31, 32, 41, 47):
        for n in (0, 1, 9, 100):
            x = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64)
            assert (ngram_jaccard._unsqueeze(ngram_jaccard._squeeze(x, bits), n, bits) == x).all()


def test_sets_of_several_batches_are_told_once(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string")
    sets = ngram_jaccard._sets(ngram_jaccard._shared(ngram_jaccard._post(docs, 3, 4), 4), 0.6, 4).collect()
    assert docs.rdd.getNumPartitions() > 1 and len(sets) == len({r.set_id for r in sets}) == 20


def test_keep_one_shuffles_texts_once(spark):
    docs = spark.createDataFrame([(k, f"some words {k} of a text {k * k}") for k in range(50)], "doc_id long, text string")
    plan = ngram_jaccard.keep_one(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_one_row_of_a_class_stays_whatever_its_id(spark):
    same, other = "one text that several rows have in common here", "quite another text about some other thing altogether"
    rows = [(None, same), (None, same), (7, same), (7, same), (7, other), (None, other + " x y"), (9, "a text of its own that nothing is like at all"), (None, "null id alone with words of its own"), (None, "null id alone with words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_v", F.lit("v")).withColumn("_set", F.lit("s"))
    got = sorted((str(r.doc_id), r.text) for r in ngram_jaccard.keep_one(docs).collect())
    assert got == sorted([("7", same), ("7", other), ("9", rows[6][1]), ("None", rows[7][1])])


def plain_fingerprint(text):
    """The definition, a word and a bit at a time."""
    import hashlib
    import re
    from collections import Counter

    votes = [0] * 64
    words = Counter(re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower()))
    for word, n in words.items():
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
        for i in range(64):
            votes[i] += n.bit_length() if h >> i & 1 else -n.bit_length()
    return sum(1 << i for i in range(64) if votes[i] > 0) if words else None


def test_simhash_equals_sql_and_brute_force(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = {tuple(r) for r in QUERIES["op10_simhash"](spark, SMALL).select("doc_id", "fingerprint", "class_id", "links", "copies").collect()}
    assert got == set(con.sql(ORACLES["op10_simhash"]).fetchall()) and any(r[3] for r in got) and any(r[4] for r in got)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert {r[0]: r[1] if r[1] is None else r[1] % 2**64 for r in got} == {r.doc_id: plain_fingerprint(r.text) for r in rows}


@pytest.mark.parametrize("radius,extra", [(6, 3), (3, 3), (6, 1)])
def test_simhash_pairs_are_all_within_the_radius_once(spark, radius, extra):
    rng = random.Random(5)
    values = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for bit in rng.sample(range(64), rng.randrange(9)):
                x ^= 1 << bit
            values.add(x - 2**64 if x >> 63 else x)
    want = {(a, b, (a ^ b) % 2**64) for a, b in itertools.combinations(sorted(values), 2)}
    want = {(a, b, x.bit_count()) for a, b, x in want if x.bit_count() <= radius}
    got = [tuple(r) for r in simhash.pairs(spark.createDataFrame([(v,) for v in values], "v long"), radius, extra).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_simhash_finds_near_copies(spark):
    """A text of 200 words and copies in which two are edited share a class; unrelated ones don't."""
    rng = random.Random(6)
    docs = []
    for g in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for k in range(3):
            w = list(base)
            for at in rng.sample(range(200), 2 if k else 0):
                w[at] = f"n{rng.randrange(10**9)}"
            docs.append((len(docs), g, " ".join(w)))
    out = {r.doc_id: r.class_id for r in simhash.near(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")).collect()}
    caught = [out[i] == out[3 * g] for i, g, _ in docs]
    assert sum(caught) >= 0.9 * len(docs)
    assert all(out[i] // 3 == g for i, g, _ in docs)


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.cache().collect()
        ids.append({r.doc_id for r in rows})
        assert ids[-1] <= ids[-2]
        if name == "packing":  # all that the mixture has, and no more
            want = sorted((r.doc_id, max(1, len(r.text) // 4)) for r in docs.collect())
            got: dict = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
            sums: dict = {}
            for k, n in want:
                sums[k] = sums.get(k, 0) + n
            assert got == sums
        docs = out
    assert "pipeline" in entry.queries()


def test_pipeline_runs_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(4, 0, 1), (6, 1, 0), (7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("some", awkward), ("none", awkward.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {"doc_id", "piece", "tokens", "sequence", "start"} <= set(rows[0].asDict())
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence, []).append((r.start, r.start + r.tokens))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False)) and x[-1][1] <= packing.CAPACITY
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    # without the label table's columns for other languages or sources
    bare = awkward.select("doc_id", "text")
    assert toxicity.train(bare, labels).classes and mixing.train(bare, labels).domains


def test_sharding_rounds_stay_cheap(spark):
    """Each round costs about the same: no plan grows with their number."""
    import time

    docs = spark.createDataFrame([(i, f"a line that is shared by group {i % 12} of all\nwords of {i} alone") for i in range(240)], "doc_id long, text string")
    took = []
    for rounds in (4, 12):
        began = time.perf_counter()
        sharding.shard(docs, shards=5, slack=0.1, rounds=rounds).count()
        took.append(time.perf_counter() - began)
    assert took[1] < 6 * took[0]
