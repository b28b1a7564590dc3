"""Each operator against a brute-force version on small inputs, and on awkward ones."""

from __future__ import annotations

import datetime
import hashlib
import html as html_lib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from colaudit.llm import bpe, chat, components, decontaminate, entries, html, pii, quality, resample, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "r", "s", "x") for c in ("a", "e", "ou", "im")]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(VOCAB) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows, columns whose names clash with inner ones."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, text(4, 60)), (4, text(4, 60)), (None, text(5, 60)), (6, text(6, 60_000)), (7, "x" * 200_000), (8, "é ß 日本 \U0001f600 " * 5), (9, text(4, 60)), (10, "one")]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    for c in ("fp", "id", "node", "k", "h", "pos", "at", "key", "words", "lines", "ids", "component_id", "kept", "score", "n_words", "item_id", "host"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


# --- components ----------------------------------------------------------------------------------


def brute_components(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(3, 3), (None, 4), (200, 7), (200, 7)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute_components(edges)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 html ---------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy <p>now</p></div>"
    "<article><h1>Head&amp;line</h1><p><b>First  &lt;b&gt;<br>line.<p>Second\n line &eacute;.</p><div class='post-comments'><p>Me too</p></div><form><p>Mail</p></form></article><aside>More</aside><div id='cookie-notice'>Cookies</div><footer>&copy; {0}</footer></body></html>"
)


def test_structure():
    lines = html.blocks(PAGE.format("x"))
    assert html.main_text(lines, None)[0] == "Head&line\nFirst <b> line.\nSecond line é."
    assert html.blocks(None) == html.blocks("") == []
    assert html.blocks("plain <b>text") == [("plain text", html.PLAIN)]
    assert html.blocks("<div><script>never closed <p>x</p>") == []
    assert html.main_text(html.blocks("<p hidden>a<p>b<p style='display:none'>c</p>d"), None)[0] == "b\nd"


@pytest.mark.parametrize(
    ("page", "left"),
    [
        ("<div class='has-sidebar'><article>Body</article></div>", "Body"),
        ("<main class='content related-posts'>Body</main>", "Body"),
        ("<div class='sidebar'>Links<article>Body</article></div>", "Body"),
        ("<article>Body<div class='site-footer'>Foot</div></article>", "Body"),
        ("<article>Body<section id='comments'><article class='comment'>Me too</article></section></article>", "Body"),
        ("<article>Body<div class='leadership banners-of-war'>More</div></article>", "Body\nMore"),
    ],
)
def test_names_of_wrappers(page, left):
    assert html.main_text(html.blocks(page), None)[0] == left


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    r = random.Random(2)
    for n in [14] * 200 + [150] * 5:
        a, b = ([r.choice("abcd") for _ in range(r.randrange(n))] for _ in range(2))
        at = sorted(html.shared(a, b))
        assert len(at) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in at)


def test_differencing(spark):
    plain = "<body><div><p>Menu</p><p>{0}</p><p>Body of {0}</p><p>Contact us</p></div></body>"
    rows = [(i, f"http://H.example.com/a/{i}?q=1", plain.format(f"page {i}")) for i in range(6)] + [(9, "http://other.example.com/x", plain.format("alone")), (10, None, None), (11, "http://h.example.com/a/7", ""), (12, "http://z.example/1", PAGE.format("x")), (13, "http://z.example/2", PAGE.format("x")), (13, "http://z.example/2", PAGE.format("x"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.extract(df, 1).collect()}
    assert [got[i]["text"] for i in range(1, 5)] == [f"page {i}\nBody of page {i}" for i in range(1, 5)] and got[2]["n_shared"] == 2  # menu and contact
    assert got[9]["text"].startswith("Menu\n") and got[10]["text"] == got[11]["text"] == ""
    assert got[12]["text"] == got[13]["text"] == "Head&line\nFirst <b> line.\nSecond line é."  # a shared article stays
    assert html.extract(df.limit(0)).count() == 0 and html.extract(df).count() == len(rows)


def test_differencing_decides_beside_articles(spark):
    page = "<body><div>Menu</div><nav>Home</nav><article><p>Read {0}</p><p>Same</p></article><div>{1}</div><div>Contact</div><footer>Foot {0}</footer></body>"
    rows = [(i, f"http://t.example/{i}", page.format(i, f"More {i}")) for i in range(3)] + [(5, "http://v.example/1", page.format(5, "More"))]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 2).collect()}
    # menu, navigation and contact are shared; the shared line of the article stands, the unshared footer falls
    assert all(got[i] == (f"Read {i}\nSame\nMore {i}", 3) for i in range(3))
    assert got[5] == ("Read 5\nSame", 0)  # no neighbour


def test_nearest_path_by_segments(spark):
    page = "<body><p>Own {0}</p>{1}</body>"
    rows = [(1, "http://n.example/a/b", page.format(1, "<p>near</p>")), (2, "http://n.example/a/b-x", page.format(2, "<p>far</p>")), (3, "http://n.example/a/b/c", page.format(3, "<p>near</p><p>far</p>"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 2).collect()}
    assert got[3] == "Own 3\nfar"


def brute_differencing(rows):
    """Differencing over the distinct pages of each host, in one list; (page_id, url) -> results."""
    order = lambda i, u: (u.split("/")[2], u.split("/")[3:], u, i is not None, i or 0)
    first: dict = {}
    for i, u, h in sorted(rows, key=lambda r: order(*r[:2])):
        first.setdefault((u.split("/")[2], h), (i, u, h))
    line = list(first.values())
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    found = {}
    for k, (_, u, h) in enumerate(line):
        near = [o for o in (line[k - 1 : k] if k else []) + line[k + 1 : k + 2] if o[1].split("/")[2] == u.split("/")[2]]
        best = max(near, key=lambda o: same(o[1].split("/")[3:], u.split("/")[3:])) if near else None
        found[u.split("/")[2], h] = html.main_text(html.blocks(h), html.blocks(best[2]) if best else None)
    return sorted((i is None, i or 0, u, *found[u.split("/")[2], h]) for i, u, h in rows)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_copies_and_edges(spark, parts):
    r = random.Random(5)
    page = lambda k: "<body>" + "".join(f"<p>{x}</p>" for x in ["Menu", f"Section {k % 3}", f"Body {k}", "Contact"]) + "</body>"
    rows = [(i, f"http://h.example/a/{i:02}", page(0)) for i in range(5)]  # one run of copies
    rows += [(i, f"http://h.example/{r.choice('ab')}/{r.choice('xyz')}/{i}", page(r.randrange(12))) for i in range(5, 40)]
    rows += [(i, f"http://{r.choice('kmn')}.example/{r.choice('ab')}/{i % 7}", page(r.randrange(6))) for i in range(40, 80)] + [(None, "http://o.example/b", page(1)), (80, "http://o.example/c", page(2)), (80, "http://o.example/c", page(2))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), parts).collect()
    assert sorted((x["page_id"] is None, x["page_id"] or 0, x["url"], x["text"], x["n_shared"]) for x in got) == brute_differencing(rows)
    assert len({x["text"] for x in got if x["page_id"] in range(5)}) == 1


def test_op1(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}

    def plain(h):
        a = re.sub("<br>", " ", re.search(r"<article>(.*)</article>", h, re.S)[1])
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", a))
        return "\n".join(x for x in parts if x)

    for r in entries.op1_html_extraction(spark, data).collect():
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


# --- 2 quality ------------------------------------------------------------------------------------


def brute_repeats(w):
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    return len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)})


def test_quality(spark):
    clean = text(1, 80)
    texts = [clean, None, "", "one two", "a b c d e f " * 9, clean + "\n" + clean, "\n".join(["Home | About | Contact | More"] * 3) + "\n" + text(2, 12), clean.replace(" ", "### "), "NOW!! BUY!! THIS!! GREAT!! THING!! IN!! TOWN!! TODAY!! OR!! NEVER!! AGAIN!!", clean + "\nAll rights reserved."]
    got = {r["doc_id"]: r for r in quality.assess(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(w))
    assert [got[i]["kept"] for i in range(len(texts))] == [True, False, False, False, False, False, False, False, False, True]
    assert got[9]["clean_text"] == clean and got[9]["n_bad_lines"] == 1


def test_quality_awkward(spark):
    d = awkward(spark)
    assert quality.assess(d).count() == d.count() and quality.assess(d.limit(0)).count() == 0
    plan = quality.assess(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- 3 resampling ---------------------------------------------------------------------------------


def junk(seed):
    return " ".join(f"{w}$$$ ###" for w in text(seed, 80).split())


def grams(t, buckets):
    return [int(b) for _, _, _, found in resample.ngrams(pa.array([t], pa.string()), buckets) for b in found]


def brute_resampling(texts, labels, buckets, smooth, rate):
    """doc_id -> (log importance, key, kept), by plain loops."""
    good = [i for i in labels if labels[i] == 1]  # in the order of their hashes
    target, held = good[::2], good[1::2]
    bags = [Counter(grams(t, buckets)) for t in texts]
    raw, aim = sum(bags, Counter()), sum((bags[i] for i in target), Counter())
    n, m = sum(raw.values()), sum(aim.values())
    p = {b: (raw[b] + 0.5) / (n + 0.5 * buckets) for b in raw}
    ratio = {b: math.log((aim[b] + smooth * buckets * p[b]) / (m + smooth * buckets)) - math.log(p[b]) for b in raw}
    log = [sum(ratio[b] * c for b, c in bag.items()) * min(1, resample.PASSAGE / max(1, sum(bag.values()))) for bag in bags]
    key = [x + resample.gumbel(i) for i, x in enumerate(log)]
    least = sorted(log[i] for i in held)[int((1 - rate) * len(held))]
    k = sum(x >= least - 1e-9 for x in log)
    return {i: (log[i], key[i], key[i] >= sorted(key)[-k]) for i in range(len(texts))}


@pytest.mark.parametrize(("smooth", "rate"), [(256.0, 0.995), (1.0, 0.9)])
def test_resampling(spark, smooth, rate):
    texts = [text(i, 400 if i % 7 == 1 else 80) if i % 5 else junk(i) for i in range(200)]
    rows = [(i, int(i % 5 > 0)) for i in range(0, 200, 3)]
    labels = spark.createDataFrame(rows + [(None, 1), (7, None)], "doc_id long, quality int")
    order = [r[0] for r in spark.createDataFrame(rows, "doc_id long, q int").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in resample.resample(d, labels, smooth=smooth, rate=rate).collect()}
    want = brute_resampling(texts, {i: dict(rows)[i] for i in order}, resample.bucket_count(d), smooth, rate)
    for i in range(200):
        assert abs(got[i]["log_importance"] - want[i][0]) < 1e-6 and abs(got[i]["key"] - want[i][1]) < 1e-6 and got[i]["kept"] == want[i][2]
    few = [r for r in resample.resample(d, labels, k=17, smooth=smooth).collect() if r["kept"]]
    assert {r["doc_id"] for r in few} == {i for i, _ in sorted(got.items(), key=lambda x: -x[1]["key"])[:17]}
    kept = resample.sample(d.withColumn("key", F.lit(1)), labels, smooth=smooth, rate=rate)
    assert kept.columns[-1] == "key" and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    if smooth == 1.0:  # junk and text are far apart
        assert not any(got[i]["kept"] for i in range(0, 200, 5)) and sum(got[i]["kept"] for i in range(200)) > 130


def test_buckets_grow_with_the_corpus(spark):
    sizes = [resample.bucket_count(docs(spark, ["x" * 50_000] * n)) for n in (1, 600, 1_200)]
    assert sizes[0] == resample.MIN_BUCKETS and sizes[1] < sizes[2]


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100, 101, 0])
def test_kth_greatest(spark, k):
    values = [float(i // 3) for i in range(100)]
    got = resample.kth_greatest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, parts=4)
    assert got == (float("-inf") if k > 100 else float("inf") if k < 1 else sorted(values)[-k])


def test_resampling_awkward(spark):
    d, labels = awkward(spark), spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert resample.resample(d, labels).count() == d.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert resample.resample(d, none).where("kept").count() == d.count() == resample.sample(d, none).count()
    assert resample.resample(d.limit(0), labels).count() == 0 and resample.sample(d.limit(0), labels).columns == d.columns


# --- 4 toxicity -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    bad = ["vilest", "rottenly", "scumish"]
    r = random.Random(3)
    texts = [text(i, 40) + (" " + " ".join(r.choices(bad, k=2)) if i % 4 == 0 else "") for i in range(400)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)] + [(None, 1), (9999, 1), (1, None)], "doc_id long, toxic int")
    return d, labels


def test_toxicity(spark, toxic):
    got = toxicity.toxicity(*toxic).collect()
    assert len(got) == 400 and 50 < sum(r["held_out"] for r in got) < 150
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1 for r in got)
    hit = next(r for r in got if r["predicted"] and r["held_out"])
    assert hit["evidence"][0]["label"] == 1 and all(a["cosine"] >= b["cosine"] - 1e-12 for a, b in zip(hit["evidence"], hit["evidence"][1:]))


@pytest.mark.parametrize("labels", [(0, 0, 0, 1, 1), (1, 1, 0, 0, 0), (0, 1, 0, 1, 0)])
def test_equal_votes_are_pooled(labels):
    index = toxicity.Index.__new__(toxicity.Index)
    index.labels, index.terms, index.weights = np.array(labels, float), [None] * 5, [None] * 5
    index.nearest = lambda *a: (np.array([0]), np.array([1.0]))
    index.vote = lambda at, cos: 0.5
    index.calibrate(np.array([1.0, 1.0]))
    assert index.x.tolist() == [0.5] and abs(index.y[0] - 2.02 / 6) < 1e-12


def test_held_out_labels_are_not_used(spark, toxic):
    d, labels = toxic
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_neighbours_are_exact():
    r = np.random.default_rng(1)
    examples = [(i, int(r.random() < 0.5), {int(t): int(r.integers(1, 4)) for t in set(r.integers(0, 40, r.integers(1, 12)))}) for i in range(500)]
    idf = r.random(40) + 0.5
    index = toxicity.Index(examples, idf, (1.0, 1.0), block=16)
    dense = np.zeros((len(index.ids), 40))
    for n, (t, w) in enumerate(zip(index.terms, index.weights)):
        dense[n, t] = w
    for _ in range(50):
        ids, w = toxicity.vector({int(t): 1 for t in set(r.integers(0, 40, 6))}, idf)
        q = np.zeros(40)
        q[ids] = w
        cos = dense @ q
        at, got = index.nearest(ids, w, 10)
        assert np.allclose(got, np.sort(cos)[::-1][:10]) and np.allclose(cos[at], got)


def test_toxicity_awkward(spark, toxic):
    d = awkward(spark)
    model = toxicity.fit(*toxic)
    assert toxicity.score(d, model).where("score between 0 and 1").count() == d.count()
    none = toxicity.toxicity(d, toxic[1].limit(0))
    assert none.where("score = 0 and predicted = 0").count() == d.count() and toxicity.toxicity(d.limit(0), toxic[1]).count() == 0


def test_held_out_accuracy(spark):
    """On the given documents; the labels of the held-out fold are compared, never learnt."""
    d = "/root/testdata/sf0.01"
    got = entries.op4_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    rank, n1 = got.score.rank(), (got.toxic == 1).sum()
    assert (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1)) > 0.9


# --- 5 simhash ------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(w)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("tile", [16_384, 7])
def test_near_duplicates(spark, tile):
    r = random.Random(4)
    base = [text(i, 150) for i in range(12)]
    texts = base + [b.replace(r.choice(b.split()), "changed", 1) for b in base for _ in range(4)] + base[:5] * 3 + [None, "", "  ", "Some Words", "some words"]
    got = {x["doc_id"]: x for x in simhash.near_duplicates(docs(spark, texts), tile_rows=tile).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = brute_components(edges)
    assert {i: got[i]["component_id"] for i in got} == {i: want.get(i, i) for i in got}


def test_tiles_skip_nothing(spark):
    r = np.random.default_rng(6)
    fps = r.integers(0, 2**63, 3000, dtype=np.uint64)
    near = fps[:300] ^ (np.uint64(1) << r.integers(0, 63, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 300).astype(np.uint64))
    every = np.unique(np.concatenate([fps, near])).view(np.int64)
    rows = spark.createDataFrame([(int(f),) for f in every], "fp long")
    found = simhash.links(rows, tile_rows=200).collect()
    u = every.view(np.uint64)
    want = [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 4).tolist()]
    at = {int(f): i for i, f in enumerate(every)}
    assert brute_components([(at[x["u"]], at[x["v"]]) for x in found]) == brute_components(want)


def test_dense_groups_give_a_forest():
    u = np.arange(3000, dtype=np.uint64) % np.uint64(16) | (np.arange(3000, dtype=np.uint64) << np.uint64(40) & np.uint64(0xF << 40))
    u = np.unique(u)
    a, b = simhash.compare(u, u, True, 4)
    assert len(a) < len(u)


def test_rows_without_an_id_link_others(spark):
    words = text(1, 400).split()
    chain, fps = [words], [brute_fingerprint(" ".join(words))]
    for k in range(0, 400, 2):  # a chain of texts whose ends are further apart than neighbours
        nxt = [*chain[-1][:k], f"q{k}", *chain[-1][k + 1 :]]
        chain.append(nxt)
        fps.append(brute_fingerprint(" ".join(nxt)))
    d = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    a, b, c = next((a, b, c) for a in range(len(fps)) for b in range(a + 1, len(fps)) if d(a, b) <= 4 for c in range(b + 1, len(fps)) if d(b, c) <= 4 < d(a, c))
    texts = [" ".join(chain[i]) for i in (a, b, c)]
    got = simhash.near_duplicates(spark.createDataFrame([(8, texts[0]), (None, texts[1]), (5, texts[2]), (None, "alone and apart")], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"]) for x in got if x["component_id"]) == [(0, 5), (5, 5), (8, 5)] and len(got) == 4


def test_simhash_awkward(spark):
    d = awkward(spark)
    got = simhash.near_duplicates(d)
    assert got.count() == d.count() and simhash.near_duplicates(d.limit(0)).count() == 0
    assert {r["component_id"] for r in got.where("doc_id in (1, 2, 3)").collect()} == {1}


# --- 6 substring dedup ----------------------------------------------------------------------------


def brute_repeat_words(texts):
    seen, out = set(), {}
    for i, t in texts:
        w = words(t)
        gone = set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone |= set(range(p, p + 20))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (3, 4), (4, 1)])
def test_substring(spark, batches, fanout):
    shared = text(99, 30)
    again = text(31, 22)  # comes three times in one text, with other words around it
    texts = [text(i, 60) for i in range(12)] + [text(3, 60), f"{again} {text(32, 9)} {again} {text(33, 9)} {again} {text(32, 9)}", text(20, 25) + "\n" + shared, shared + "\n" + text(21, 30), "la " * 70, "la la " * 12, text(22, 50) + " " + text(22, 50), None, "", "short"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.drop_repeats(docs(spark, texts), batches, fanout=fanout).collect()}
    assert got == brute_repeat_words(list(enumerate(texts)))


def test_index_is_incremental(spark):
    index = substring.WindowIndex(spark, fanout=2)
    texts = [text(i % 7, 50) for i in range(20)]
    got = {}
    for k in range(0, 20, 5):
        for r in index.ingest(docs(spark, texts[k : k + 5], list(range(k, k + 5)))).collect():
            got[r["doc_id"]] = (r["n_words"], r["n_removed"], r["kept_text"])
    assert got == brute_repeat_words(list(enumerate(texts))) and len(index.runs) <= 3


def test_substring_awkward(spark):
    d = awkward(spark)
    got = substring.drop_repeats(d)
    assert got.count() == d.count() and substring.drop_repeats(d.limit(0)).count() == 0
    assert [r["n_removed"] for r in got.where("doc_id = 9").collect()] == [60]


# --- 7 chat ---------------------------------------------------------------------------------------

EVENTS = "conv_id long, seq long, op string, role string, text string, ref long"


def shown(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, EVENTS)).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out.collect()}


def test_fold(spark):
    rows = [
        (1, 1, "message", "user", "hi", None), (1, 2, "message", "assistant", "He", None), (1, 3, "delta", None, "llo", None), (1, 4, "edit", None, "Hi you", 0), (1, 5, "delta", None, "!", None),
        (2, 1, "message", "user", "q", None), (2, 2, "message", "assistant", "bad", None), (2, 3, "message", "user", "later", None), (2, 4, "regenerate", None, "go", 1), (2, 5, "delta", None, "od", 1), (2, 6, "message", "user", "thanks", None),
        (3, 1, "delta", None, "lost", None), (3, 2, None, "user", None, None), (3, 3, "delta", None, "x", 9), (4, 1, "delta", None, "nothing", None),
    ]
    got = shown(spark, rows)
    assert got[1] == ([("user", "Hi you"), ("assistant", "Hello!")], ["Hello!"])
    assert got[2] == ([("user", "q"), ("assistant", "good"), ("user", "thanks")], ["good"])
    assert got[3] == ([("user", "")], []) and 4 not in got


def brute_fold(rows):
    """The final messages by a loop over the events in order."""
    begun, dropped, now = [], set(), None
    for op, role, t, ref in rows:
        if op == "message":
            begun.append([role or "", t or ""])
            now = len(begun) - 1
            continue
        to = now if ref is None else ref
        if to is None or not 0 <= to < len(begun):
            continue
        begun[to][1] = begun[to][1] + (t or "") if op == "delta" else t or ""
        if op == "regenerate":
            dropped |= set(range(to + 1, len(begun)))
            now = to
    return [tuple(m) for k, m in enumerate(begun) if k not in dropped]


def test_fold_equals_a_loop(spark):
    r = random.Random(17)
    logs = {}
    for c in range(200):
        ops = r.choices(["message", "delta", "edit", "regenerate"], [4, 4, 1, 2], k=r.randrange(1, 14))
        logs[c] = [(op, r.choice(("user", "assistant")) if op == "message" else None, r.choice(("a", "bb", None, "é")), None if op == "message" or r.random() < 0.6 else r.randrange(-1, 5)) for op in ops]
    logs[500] = [("message", "user", "q", None), ("message", "assistant", "bad", None), ("message", "user", "later", None), ("regenerate", None, "go", 1), ("delta", None, "od", None)]
    rows = [(c, k, *e) for c, log in logs.items() for k, e in enumerate(log)]
    got = shown(spark, rows)
    for c, log in logs.items():
        assert (got[c][0] if c in got else []) == brute_fold(log), log
    assert got[500][0] == [("user", "q"), ("assistant", "good")]


def test_escapes_are_reversible(spark):
    r = random.Random(8)
    parts = ["<|", "|>", "\\", "<", "|", "im_end", chat.END, chat.START, "\n", "n", "é", "\U0001f600", "<\\|", " "]
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(300)]
    rows = [(i, k, "message", role, t, None) for i, t in enumerate(texts) for k, role in enumerate((t, "assistant"))]
    for i, (turns, loss) in shown(spark, rows).items():
        assert turns == [(texts[i], texts[i]), ("assistant", texts[i])] and loss[-1] == texts[i]


def test_chat_awkward(spark):
    rows = [(None, None, None, None, None, None), (None, 1, "message", "user", "a", None), (5, 1, "message", "user", "a", None), (5, 1, "message", "user", "a", None), (5, 1, "message", "assistant", "b" * 100_000, None)]
    d = spark.createDataFrame(rows, EVENTS).withColumn("position", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.format_chats(d).collect()}
    assert got[5]["formatted"].count(chat.START) == 3 and set(got) == {None, 5}
    assert chat.format_chats(d.limit(0)).count() == 0
    plan = chat.format_chats(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 8 bpe ----------------------------------------------------------------------------------------

PATH = public_tokenizers.path(entries.VOCABULARY)


@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe(spark, reference_encoding):
    r = random.Random(9)
    texts = [text(i, 60) for i in range(10)] + ["".join(r.choices("abcdeéß日本語 \n\t'1234567890\U0001f600", k=400)) for _ in range(60)] + ["a" * 3000, "ab" * 900, "<|endoftext|> x", "", None, " "]
    got = {x["doc_id"]: x for x in entries.bpe_round_trip(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == reference_encoding.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()


def test_long_matches():
    ranks = bpe.read_ranks(PATH)
    r = random.Random(10)
    t = "".join(r.choices("abcdefgh", k=50_000)).encode()
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in bpe.merge(t, ranks)) == t


def test_op8(spark, data, reference_encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in entries.op8_byte_bpe(spark, data).collect():
        ids = reference_encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_awkward(spark):
    d = awkward(spark)
    assert entries.bpe_round_trip(d).count() == d.count() and entries.bpe_round_trip(d.limit(0)).count() == 0


# --- 9 pii ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 10**6])
def test_feistel_permutes(size):
    f = pii.Feistel(b"k", "t")
    xs = range(size) if size <= 1000 else range(0, size, 997)
    out = [f.permute(x, size) for x in xs]
    assert len(set(out)) == len(out) and all(0 <= y < size for y in out) and [f.permute(y, size, True) for y in out] == list(xs)


PRIVATE = ["anna.smith@mail.example.com", "4111 1111 1111 1111", "9807915762804490", "+1 (017) 555-7713", "97.51.17.173", "DE89 3704 0044 0532 0130 00", "123-45-6789", "2024-02-29", "31.12.1999", "12/31/1999"]


def test_pseudonyms(spark):
    texts = [f"Say {v}, then {v}; end" for v in PRIVATE] + ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Version 3.0 of 1999, page 12, 4.0 and 2024.", None, ""]
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, texts), b"k").collect()}
    for i, v in enumerate(PRIVATE):
        m = re.fullmatch(r"Say (.*), then (.*); end", out[i]["text"])
        assert m and m[1] == m[2] != v and re.sub("[a-z]", "a", re.sub(r"\d", "9", m[1])) == re.sub("[a-z]", "a", re.sub(r"\d", "9", v)) or v == PRIVATE[4]
    n = len(PRIVATE)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[n]["text"]) and "04dbebab" not in out[n]["text"]
    assert out[n + 1]["text"] == texts[n + 1] and out[n + 2]["text"] is None and out[n + 3]["text"] == ""
    back = pii.pseudonymise(spark.createDataFrame([(r["doc_id"], r["text"]) for r in out.values()], "doc_id long, text string"), b"k", back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("n", [200, 255, 256, 1_000, 20_000])
def test_long_secrets(n):
    r = random.Random(n)
    draw = lambda chars, k: "".join(r.choices(chars, k=k))
    token, digits, letters = "eyJ" + draw("abcXYZ019_-.", n - 3), draw("0123456789abcdef", n), draw("abcdefgh", n)
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    cases = [("token=", token), ("secret: ", token), ("hash ", digits), ("hash ", digits.upper()), ("use ghp_", token.replace(".", "a")), ("use sk-", letters), ("", letters + "@example.com")]
    for lead, v in cases:
        old = f"{lead}{v}, end"
        new, spans = p.apply(old)
        m = re.fullmatch(re.escape(lead) + "(.*), end", new)
        assert m and len(spans) == 1 and len(m[1]) == len(v) and spans[0][2] == len(lead + v)
        # of the characters that can change, about as many stay as by chance, in each tenth of the value
        for k in range(0, n, 100):
            assert sum(a == b for a, b in zip(m[1][k : k + 100], v[k : k + 100])) < 60
        assert back.apply(new)[0] == old
    assert all(c in "0123456789abcdef" for c in p.apply("hash " + digits)[0][5:])
    a, b = (p.apply(f"token={'ab3' * n}{x}")[0] for x in "xy")  # the ends alone differ
    assert sum(x != y for x, y in zip(a, b)) > n


def test_long_values_are_linear():
    texts = ["token=" + "aB3." * 100_000, "x" + "f" * 400_000, "a1" * 200_000, "token " * 60_000, "sk-" * 100_000]
    start = time.monotonic()
    for t in texts:
        assert pii.Pseudonyms(b"k", back=True).apply(pii.Pseudonyms(b"k").apply(t)[0])[0] == t
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("sizes", [[], [10], [26, 10], [2, 3, 2, 3]])
def test_digits_permute(sizes):
    f = pii.Feistel(b"k", "t")
    xs = [list(x) for x in itertools.product(*map(range, sizes))]
    out = [f.permute_digits(x, sizes) for x in xs]
    assert sorted(out) == xs and [f.permute_digits(y, sizes, True) for y in out] == xs


def test_check_digits_survive():
    p = pii.Pseudonyms(b"k")
    new = p.apply("4111111111111111")[0]
    assert pii.luhn(new[:-1]) == int(new[-1])
    bad = p.apply("4111111111111112")[0]
    assert pii.luhn(bad[:-1]) != int(bad[-1])


def test_keys_differ():
    with pytest.raises(ValueError):
        pii.Pseudonyms(b"")
    assert pii.Pseudonyms(b"a").apply("9807915762804490")[0] != pii.Pseudonyms(b"b").apply("9807915762804490")[0]


@pytest.mark.parametrize(
    ("before", "value", "after"),
    [
        ("pay to ", "ES9121000418450200051332", " EUR now"), ("pay to ", "ES91 2100 0418 4502 0005 1332", " EUR"), ("", "BE68 5390 0754 7034", " PAID"), ("x ", "DE89370400440532013000", ""),
        ("NO ", "NO93 8601 1117 947", " AND MORE WORDS"), ("amex ", "3782 822463 10005", "."), ("ip ", "2001:db8:85a3::8a2e:370:7334", ", ok"), ("ip ", "FE80:0:0:0:202:B3FF:FE1E:8329", " ok"),
        ("hw ", "00:1A:2b:3C:4d:5E", " end"), ("hw ", "aa-bb-cc-dd-ee-ff", " end"), ("password is ", "hunter22x", ", she said"), ("token is '", "abc123defg", "'"), ("api_key = ", "Zx81kkpqrs", ""),
    ],
)
def test_values_are_found_whole(before, value, after):
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    new, spans = p.apply(before + value + after)
    assert [(a, b) for _, a, b in spans] == [(len(before), len(before) + len(value))]
    assert new.startswith(before) and new.endswith(after) and len(new) == len(before + value + after)
    kept = sum(a == b for a, b in zip(new[len(before) :], value) if a.isalnum())
    assert kept <= 2 + sum(map(str.isalnum, value)) // 2 and back.apply(new)[0] == before + value + after


@pytest.mark.parametrize("t", ["ES9121000418450200051333 EUR", "at 12:30:45 or ::1", "the password is required", "std::vector 1", "AB12 FOO BAR BAZ QUX QUUX", "a:b:c 1", "token is validated", "Section 12:3:4 of it"])
def test_prose_stays(t):
    assert pii.Pseudonyms(b"k").apply(t) == (t, [])


def test_spans_replace_a_column_of_that_name(spark):
    d = docs(spark, ["call +49 30 1234567", None]).withColumn("PII_spans", F.lit("clash"))
    rows = pii.pseudonymise(d, b"k").collect()
    assert [r.__fields__ for r in rows] == [["doc_id", "text", "lang", "source", "n_chars", "pii_spans"]] * 2
    assert [len(r["pii_spans"]) for r in rows] == [1, 0]


def test_pii_awkward(spark):
    d = awkward(spark).withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.repeat(F.lit("9"), 100_000), F.repeat(F.lit("a."), 50_000))).otherwise(F.col("text")))
    got = pii.pseudonymise(d, b"k", spans=None)
    assert got.columns == d.columns and got.count() == d.count() and pii.pseudonymise(d.limit(0), b"k").count() == 0


@pytest.mark.parametrize(("y", "m", "d"), [(1999, 12, 31), (2001, 2, 28), (1987, 5, 6), (2012, 11, 12), (2050, 1, 13)])
def test_a_date_has_one_pseudonym_in_all_styles(y, m, d):
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    us = f"{m:02}/{d:02}/{y}"
    styles = {f"{y}-{m:02}-{d:02}": "%Y-%m-%d", f"{d:02}.{m:02}.{y}": "%d.%m.%Y", us: "%m/%d/%Y"} | ({f"{d:02}/{m:02}/{y}": "%d/%m/%Y"} if d > 12 else {})
    found = {t: p.apply(f"on {t} it")[0][3:-3] for t in styles}
    assert len({datetime.datetime.strptime(found[t], f) for t, f in styles.items()}) == 1
    assert all(back.apply(f"on {x} it")[0] == f"on {t} it" for t, x in found.items())


# --- 10 decontamination ---------------------------------------------------------------------------


def test_leaks(spark):
    items = [text(500 + i, 14 + 3 * i) for i in range(12)] + [None, "", "tiny item"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    r = random.Random(12)

    def changed(t, k):
        w = t.split()
        for i in r.sample(range(len(w)), k):
            w[i] = "other"
        return " ".join(w)

    texts = [text(i, 80) for i in range(20)] + [text(40 + i, 30) + " " + items[i].upper() + " " + text(60 + i, 30) for i in range(12)] + [text(80 + i, 20) + " " + changed(items[i], 2) for i in range(4, 12)] + [None, ""]
    for block in (200_000, 40):
        got = decontaminate.leaks(docs(spark, texts), bench, block_tokens=block).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got if x["n_span"] >= 14} >= {(20 + i, i) for i in range(12)} | {(28 + i, i) for i in range(4, 12)}
        assert {x["doc_id"] for x in got} == set(range(20, 40))
        full = {(x["doc_id"], x["item_id"]): x for x in got}[20, 0]
        assert (full["doc_start"], full["item_start"], full["n_equal"]) == (30, 0, 14)
    clean = decontaminate.without_leaks(docs(spark, texts), bench)
    assert sorted(x["doc_id"] for x in clean.collect()) == [*range(20), 40, 41]


def brute_leaks(texts, items):
    """All alignments of all items with all texts; (text, item) that overlap."""
    split = lambda t: np.array([c for w in words(t) if (c := "".join(filter(str.isalnum, w.lower())))], object)
    found = set()
    items = [split(t) for t in items]
    for d, t in enumerate(texts):
        t = split(t)
        for k, item in enumerate(items):
            least = min(12, len(item))
            for shift in range(least - len(item), len(t) - least + 1) if least else ():
                a, b = max(0, -shift), min(len(item), len(t) - shift)
                equal = (item[a:b] == t[a + shift : b + shift]).astype(bool)
                if equal.sum() >= 0.8 * least - 1e-9:
                    i, j = decontaminate.longest(equal, 0.8)
                    if j - i >= least and (len(item) >= 5 or len(t) == len(item)):
                        found.add((d, k))
    return found


def test_short_items(spark):
    r = random.Random(21)
    items = [" ".join(r.choice(VOCAB) + r.choice("xy") for _ in range(n)) for n in range(1, 12) for _ in range(3)]
    texts = [text(700 + i, 12) for i in range(10)] + ["", None, "one"]
    for item in items:
        w = item.split()
        for places in ([], *itertools.combinations(range(len(w)), 1), *itertools.combinations(range(len(w)), 2)):
            copy = " ".join("other" if i in places else x for i, x in enumerate(w))
            texts += [f"{text(len(texts), 5)} {copy} {text(len(texts), 5)}"]
    got = decontaminate.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_tokens=60).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == brute_leaks([t or "" for t in texts], items)


def test_items_of_a_few_words_must_be_the_whole_text(spark):
    items = [(1, "Yes"), (2, "Is it so?"), (3, "one two three four"), (4, "one two three four five")]
    texts = ["yes", "Yes, it is", "is it so", "so is it so or not", "one two three four", "zero one two three four five six", "YES!", "Is it"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs(spark, texts), bench).collect()} == {(0, 1), (2, 2), (4, 3), (5, 4), (6, 1)}
    left = decontaminate.without_leaks(docs(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} >= {1, 3, 7}


@pytest.mark.parametrize("n", [12, 16, 25, 40])
def test_recall_of_long_overlaps(n):
    """Passages of n tokens of which a fifth is changed at random places."""
    r = random.Random(n)
    item = [f"w{r.randrange(10**9)}" for _ in range(n)]
    block, memo, found = decontaminate.Block([(1, " ".join(item))]), decontaminate._Words(), 0
    bitmaps = [block.bitmap(keys) for _, keys, _, _ in block.tables]
    texts = []
    for _ in range(1000):
        places = set(r.sample(range(n), n // 5))
        texts.append(" ".join(["before"] * 7 + ["other" if i in places else w for i, w in enumerate(item)] + ["after"] * 5))
    found = len(decontaminate._overlaps(texts, block, bitmaps, memo, 12, 0.8))
    assert found >= 990


def test_longest_stretch():
    r = random.Random(13)
    for _ in range(300):
        e = np.array([r.random() < 0.7 for _ in range(r.randrange(1, 25))])
        a, b = decontaminate.longest(e, 0.8)
        best = max((j - i for i in range(len(e)) for j in range(i, len(e) + 1) if e[i:j].sum() >= 0.8 * (j - i) - 1e-9), default=0)
        assert b - a == best and (best == 0 or e[a:b].sum() >= 0.8 * best - 1e-9)


def test_leaks_awkward(spark):
    d = awkward(spark)
    bench = spark.createDataFrame([(1, text(4, 60)), (1, text(4, 60)), (None, text(5, 60))], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.leaks(d, bench)
    assert {r["doc_id"] for r in got.collect()} == {4, 9, None}
    assert decontaminate.without_leaks(d, bench).columns == d.columns
    assert decontaminate.leaks(d.limit(0), bench).count() == 0 and decontaminate.leaks(d, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(d, bench.limit(0)).count() == d.count()
