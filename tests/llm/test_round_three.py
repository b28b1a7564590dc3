"""LSH forest, source divergence and fill-in-the-middle: brute force, containers, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, brute_components, docs, text, words

from colaudit.llm import divergence, infill, lshforest

# --- 11 LSH forest -------------------------------------------------------------------------------


def brute_set(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, percent=85):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [brute_set(t) for _, t in rows]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    edges = []
    for k, s in enumerate(sets):
        near = Counter(j for x in s for j in by[x] if j < k)
        edges += [(j, k) for j, n in near.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    parts = brute_components(edges)
    least = {}
    for k, (i, _) in enumerate(rows):
        c = parts.get(k, k)
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted(((i, len(s), least[parts.get(k, k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(r, t, n):
    w = t.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return " ".join(w)


def planted():
    r = random.Random(4)
    make = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    out = [make(r.randrange(1, 200)) for _ in range(60)]
    base = make(300)
    out += [edited(r, base, 4) for _ in range(150)] + [base]  # about 0.87 of the base, 0.77 of each other
    chain = make(400)
    for _ in range(40):
        chain = edited(r, chain, r.choice((3, 6, 7, 8)))
        out.append(chain)
    for t in [make(r.randrange(6, 400)) for _ in range(60)]:
        out += [edited(r, t, max(1, len(t.split()) * r.randrange(1, 6) // 100)) for _ in range(r.randrange(1, 4))] + [t] * r.randrange(1, 3)
    out += ["A b c d e f g", "a B C d e f g h", "one two", "ONE two", "one two three", "", "  "]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("near", "tile"), [(lshforest.NEAR, lshforest.TILE), (1, 3)])
def test_forest_equals_brute_force(spark, near, tile):
    rows = list(enumerate(planted()))
    d = docs(spark, [t for _, t in rows]).repartition(5)
    out = lshforest.near_duplicates(d, near=near, tile=tile).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out), key=str) == brute_near(rows)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in out)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    for common in (900, 600, 100):
        a, b = np.split(r.integers(0, 1 << 64, 2 * (1000 - common), dtype=np.uint64), 2)
        both = r.integers(0, 1 << 64, common, dtype=np.uint64)
        x, y = (lshforest.signatures(np.sort(np.concatenate((both, z))), np.zeros(1, int), 140)[0] for z in (a, b))
        true = common / (2000 - common)
        assert abs((x == y).mean() - true) < 5 * (true * (1 - true) / 140) ** 0.5 + 0.01


def test_labels_keep_the_order_of_values():
    sig = np.random.default_rng(1).integers(0, 256, (200, 140)).astype(np.uint8)
    lab = lshforest.labels(sig)
    for t in (0, 13, 27):
        at = (t * lshforest.LEAST + np.arange(lshforest.DEPTH)) % 140
        assert sorted(range(200), key=lambda k: lab[k, t]) == sorted(range(200), key=lambda k: tuple(sig[k, at]))


def test_forest_of_awkward_rows(spark):
    d = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    out = lshforest.near_duplicates(d).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out), key=str) == brute_near([(i, t) for i, t in rows])
    assert lshforest.near_duplicates(d.limit(0)).count() == 0
    # an id that stands at two texts links both
    two = docs(spark, [text(1, 80), text(2, 80), text(1, 80), text(2, 80) + " more", text(3, 50)], [5, 5, 7, 8, 9])
    assert {(x["doc_id"], x["component_id"]) for x in lshforest.near_duplicates(two).collect()} == {(5, 5), (7, 5), (8, 5), (9, 9)}


# --- 12 source divergence ------------------------------------------------------------------------


def brute_audit(rows, min_docs=3, top=200):
    """rows of (text, lang, source), by the formulas, with Python's integers."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        here = sorted(s for x, s in groups if x == lang)
        p = {s: [1 + 10**9 * (counts[lang, s][t] + 1) // (sum(counts[lang, s][u] for u in kept) + len(kept)) for t in kept] for s in here}
        whole = [sum(counts[lang, s][t] for s in here) for t in kept]
        q = [1 + 10**9 * (n + 1) // (sum(whole) + len(kept)) for n in whole]
        f = lambda a, b: (a - b) ** 2 // b
        for s in here:
            pair = sorted(((-sum(map(f, p[s], p[o])), o.encode()) for o in here if o != s))
            term = sorted((-f(a, b), t.encode()) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b)[:top]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("limit", "top"), [(divergence.LIMIT, 200), (1, 200), (7, 3)])
def test_audit_equals_brute_force(spark, limit, top):
    r = random.Random(limit)
    rows = [(" ".join(r.choice(["Éa", "bÄ", "x", "Y", "zz", "日本", "A1b", "q-r", "é", "ſ"]) for _ in range(r.randrange(12))), r.choice(["en", "de", None]), r.choice(["s", "t", "", None, "ü"])) for _ in range(80)]
    rows += [(None, "en", "only"), ("", "xx", "a"), ("!! 12", "xx", "b"), ("one two", "xx", "b"), ("rare", "yy", "z")] + [("same same", "en", "s")] * 4
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = found(divergence.audit(df, top=top, limit=limit))
    assert got == brute_audit(rows, top=top)
    assert ("xx", "a", "pair", "b", 0, 1) in got


def test_shares_are_exact():
    r = random.Random(1)
    n = [r.randrange(1 << r.randrange(1, 53)) for _ in range(500)] + [0, 9 * 10**15 - 2]
    total = [max(1, x + r.randrange(1 << r.randrange(1, 40))) for x in n]
    total = [min(t, 9 * 10**15) for t in total]
    got = divergence.share(np.array(n, np.int64), np.array(total, np.int64)).tolist()
    assert got == [1 + 10**9 * (x + 1) // t for x, t in zip(n, total)]


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "_PART", 5)
    t = "Aé-bc  defghijklmnop 1 ÄÖ日本 " * 7
    assert [w.decode() for p in divergence.pieces(t.encode()) for w in p] == ["aé", "bc", "defghijklmnop", "ÄÖ日本"] * 7


def test_audit_of_awkward_rows(spark):
    d = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in d.collect()]
    assert found(divergence.audit(d)) == brute_audit(rows)
    assert divergence.audit(d.limit(0)).count() == 0


# --- 13 fill in the middle -----------------------------------------------------------------------


def texts(r):
    ascii_, mixed = text(3, 30_000), "".join(r.choice("aé日\U0001f600\n ") for _ in range(90_000))
    sparse = "".join("日" * r.randrange(1, 400) + "a" * r.randrange(3) for _ in range(400))
    return ["", "a", "日", ascii_, mixed, sparse, "ab" * 32_768, "ab" * 32_767 + "é", "x" * 65_535 + "日" * 70_000, "\n\n", ascii_ + mixed]


def test_boundaries_select():
    kinds = set()
    for t in texts(random.Random(2)):
        data = t.encode()
        want, at = [], 0
        for c in t:
            want.append(at)
            at += len(c.encode())
        want.append(at)
        found = infill.boundaries(data)
        assert len(found) == len(t) + 1
        step = max(1, len(want) // 300)
        assert [found.select(k) for k in range(0, len(want), step)] == want[::step]
        assert found.select(len(t)) == len(data)
        for bad in (-1, len(want)):
            with pytest.raises(IndexError):
                found.select(bad)
        kinds |= {c.kind for c in found.containers}
        lines = infill.boundaries(data, "lines")
        begin = [0] * bool(data) + [i + 1 for i, c in enumerate(data[:-1]) if c == 10] + [len(data)]
        assert [lines.select(k) for k in range(0, len(lines), 997)] == begin[::997] and len(lines) == len(begin)
    assert kinds == {infill.ARRAY, infill.BITMAP, infill.RUNS}


@pytest.mark.parametrize("density", [0.0002, 0.01, 0.06, 0.3, 0.5, 0.9, 0.999, 1.0])
def test_containers_equal_a_list(density):
    r = np.random.default_rng(int(density * 10_000))
    bits = r.random(infill.CHUNK) < density
    bits[77] = True
    c, want = infill.container(bits), np.flatnonzero(bits)
    assert [c.select(k) for k in range(0, len(want), 131)] == want[::131].tolist() and c.select(len(want) - 1) == want[-1]


def brute_fim(i, t):
    h1, h2, h3, h4 = infill.choices(i)
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    x, y, z = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_fill_in_middle(spark):
    r = random.Random(9)
    many = texts(r) + ["a<P>b", "<S>", "x<M>", "<P", "S><M", "<<P", "$1\\Q|\\E"] + ["".join(r.choice("<PSM>aé") for _ in range(r.randrange(9))) for _ in range(300)]
    d = docs(spark, many)
    out = {x["doc_id"]: x for x in infill.transform(d).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()}
    for i, t in enumerate(many):
        x = out[i]
        assert (x["n"], x["form"], x["prefix_units"], x["middle_units"], x["output"]) == brute_fim(i, t)
        assert x["back"] == t
    assert {x["form"] for x in out.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_lines(spark):
    d = docs(spark, [text(k, 200) for k in range(40)])
    for x in infill.transform(d, unit="lines", rate=100).join(d, "doc_id").withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect():
        rows = x["text"].splitlines(keepends=True)
        assert x["n"] == len(rows) and x["back"] == x["text"]
        a, m = x["prefix_units"], x["middle_units"]
        assert x["output"].endswith("<M>" + "".join(rows[a : a + m]))


def test_fill_in_middle_of_awkward_rows(spark):
    d = awkward(spark)
    out = infill.transform(d).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = sorted((r["doc_id"] or 0, r["n"], r["back"]) for r in out.collect())
    assert got == sorted((r["doc_id"] or 0, len(r["text"] or ""), r["text"] or "") for r in d.collect())
    assert infill.transform(d.limit(0)).count() == 0
