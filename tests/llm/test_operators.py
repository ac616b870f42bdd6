"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import bpe, decontaminate, license_scan, minhash_dedup, quality, queries, secret_scan, suffix_dedup, topk_search, unit_dedup, url_filter
from sheetloom.llm.common import words_of

TEXTS = "doc_id long, text string"
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TEXTS)


def test_topk_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 6)).round(2))]
    rows += [(900, rows[0][1]), (901, None), (902, [1.0, None]), (903, [float("nan")] * 6), (904, []), (905, [1.0, 2.0]), (None, rows[1][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", k=7, block_rows=64).collect()
    ok = {i: [int(np.floor(1024 * x)) for x in e] for i, e in rows if i is not None and e and len(e) == 6 and all(x == x for x in e)}
    want = []
    for q in sorted(i for i in ok if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q)[:7]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk_search.top_k(none, none, "vec_id", "embedding").count() == 0


def brute_hits(text, items, n=10):
    w = words_of((text or "").encode())
    hit, names = set(), set()
    for name, body in items:
        b = words_of((body or "").encode())
        size = min(n, len(b))
        for i in range(len(b) - size + 1 if b else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == b[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return len(w), len(hit), sorted(str(x) for x in names if x is not None)


@pytest.mark.parametrize("most", [32 << 20, 40])
def test_decontamination(spark, most):
    random.seed(1)
    word = lambda: random.choice(["ab", "b", "cd", "E", "é"])
    items = [(i, " ".join(word() for _ in range(random.randint(0, 14)))) for i in range(12)] + [(50, None), (None, "zz yy")]
    docs = [(i, " ".join(word() for _ in range(random.randint(0, 60)))) for i in range(40)] + [(100, None), (101, ""), (102, items[3][1]), (103, "ZZ, yy!"), (103, "ZZ, yy!")]
    d = spark.createDataFrame(docs, TEXTS).withColumn("items", F.lit("clash"))
    found = decontaminate.find_windows(d, spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"], most_bytes=most)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in decontaminate.report(found, "doc_id").collect())
    want = []
    for i, t in docs:
        n, h, names = brute_hits(t, items)
        want.append((i, n, h, hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0))
    assert got == sorted(want)
    kept = decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if not w[4]}


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7?x", "https://com/en/", "http://example.com/en", "ftp://x.net/de/8", "http://example.net/de/8/x", "nope", None, "://", "http://sub.org/es/#f", "http://xcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "allow"), ("org", "/es/", "block"), ("org", "/es/", "block")], url_filter.RULES)
    want = {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: (None, "allow"), 3: ("net/de/", "block"), 4: ("example.net/de/8", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("org/es/", "block"), 9: (None, "allow")}
    for most in (256 << 20, 1):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, keep=["page_id"], most_bytes=most).collect()}
        assert got == want
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_op3_rules_are_the_contracts(spark, tmp_path):
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block")}
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(urls.values()))


def test_secrets_and_ledger(spark):
    key = "0123456789abcdef" * 2
    docs = [(0, f"x token = \"{key}\" y"), (1, "token=token:abcdef"), (2, None), (3, ""), (4, "é AKIA" + "A" * 16 + f" {key[:24]}"), (5, f"x token = \"{key}\" y"), (6, "a" * 50000)]
    d = spark.createDataFrame(docs, TEXTS)
    paths, new = secret_scan.scan(d, "text")
    got = {r.doc_id: r for r in secret_scan.report(secret_scan.findings(paths, new), "doc_id").collect()}
    base = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2), "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0), "hex": (re.compile(r"[0-9a-f]+"), 24, 0)}
    for i, t in docs:
        spans = sorted((m.start(), n, k, m.end()) for n, (k, (p, least, g)) in enumerate(base.items()) for m in p.finditer(t or "") if len(m.group(g)) >= least)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and got[i].n_hex == sum(s[2] == "hex" for s in spans)
    _, ledger = secret_scan.advance(d.where("doc_id < 4"), "text")
    found, full = secret_scan.advance(d, "text", ledger)
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {i: (got[i].spans.count(":") // 2) for i in got}
    assert full.count() == len({t or "" for _, t in docs}) * len(secret_scan.RULES)
    _, again = secret_scan.scan(d, "text", full)
    assert again.count() == 0
    safe = {r.doc_id: r.text for r in secret_scan.redact(d.withColumn("blob", F.lit(1))).collect()}
    assert safe[0] == "x [SECRET]\" y" and safe[2] is None and safe[3] == "" and key[:24] not in safe[4]


def test_licenses(spark, empty):
    docs = [(0, "All rights reserved. CC-BY; cc by"), (1, None), (2, "General PUBLIC license"), (3, "Licensed under the fine Apache License, Version 2.0."), (4, "all rights"), (4, "all rights"), (5, "cc"), (6, "of " * 20000)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(docs, TEXTS).withColumn("score", F.lit(1)), keep=["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [len(got[i]) for i in range(7)] == [1, 1, 1, 1, 2, 1, 1]
    assert (got[0][0].n_base, got[0][0].first_word, got[0][0].last_word, got[0][0].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert got[1][0].n_words == 0 and got[1][0].first_word is None and got[2][0].base_labels == "gpl"
    assert "apache-2.0" in got[3][0].labels and got[3][0].base_labels == "" and got[4][0].score == 0.5
    assert license_scan.scan(empty).count() == 0


def brute_substrings(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for d, t in rows:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = 1
        yield d, len(t), int(gone.sum()), int(((gone[1:] == 0) & (gone[:-1] == 1)).sum()), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=False) if not g)).hexdigest()


def test_suffix_dedup(spark, empty):
    random.seed(3)
    base = ["".join(random.choice("ab ") for _ in range(200)) for _ in range(5)]
    rows = []
    for i in range(150):
        t = "".join(b[(a := random.randint(0, 150)) : a + random.randint(10, 120)] + "".join(random.choice("abcdé ") for _ in range(random.randint(0, 30))) for b in random.choices(base, k=random.randint(0, 4)))
        rows.append((i, t))
    rows += [(300, None), (301, ""), (302, "x" * 5000), (303, "x" * 100), (304, rows[7][1]), (304, rows[7][1]), (2, "y" * 70 + base[0]), (305, base[0] * 3)]
    got = sorted(tuple(r) for r in suffix_dedup.report(spark.createDataFrame(rows, TEXTS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(brute_substrings([(d, (t or "").encode()) for d, t in rows]))
    assert suffix_dedup.report(empty).count() == 0


def test_deep_shallow_equals_plain_sorting():
    random.seed(5)
    for _ in range(60):
        strings = []
        for g in range(random.randint(1, 6)):
            letters, base = random.choice((b"a", b"ab", b"abcdefgh", b"\x00\xff")), random.choice((1, 7, 8, 9, 31, 32, 33, 40, 50, 113))
            stem = random.choices(letters, k=base)
            for _ in range(random.randint(1, 30)):
                s = list(stem)
                for _ in range(random.randint(0, 3)):
                    s[random.randrange(base)] = random.choice(letters)
                strings.append((g, bytes(s)))
        random.shuffle(strings)
        size = np.array([len(s) for _, s in strings])
        buf = b"".join(s for _, s in strings) + bytes(suffix_dedup.PAD)
        place = suffix_dedup.deep_shallow(buf, np.cumsum(size) - size, size, np.array([g for g, _ in strings]))
        first = {}
        for i, s in enumerate(sorted(strings)):
            first.setdefault(s, i)
        assert place.tolist() == [first[s] for s in strings]


def test_blind_trie_orders_and_groups():
    random.seed(2)
    s = [bytes(random.choice(b"ab") for _ in range(12)) for _ in range(200)]
    got = suffix_dedup.blind_trie(s)
    assert [s[g[0]] for g in got] == sorted(set(s)) and sorted(i for g in got for i in g) == list(range(200))


def shingle_counts(text):
    w = words_of((text or "").encode())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_links(texts, similarity=0.8):
    """Pairs of text numbers at the similarity or more, by inverted lists over all shingles."""
    bags, holders, shared = [shingle_counts(t) for t in texts], {}, Counter()
    for i, bag in enumerate(bags):
        for s, n in bag.items():
            for j, m in holders.setdefault(s, []):
                shared[j, i] += min(n, m)
            holders[s].append((i, n))
    size = [sum(b.values()) for b in bags]
    return [(i, j) for (i, j), n in shared.items() if n >= similarity * (size[i] + size[j] - n) - 1e-9]


def brute_classes(rows):
    ids, root = [i for i, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in brute_links([t for _, t in rows]):
        root[find(i)] = find(j)
    least = {}
    for n, i in enumerate(ids):
        least[find(n)] = min(i, least.get(find(n), i))
    return {i: least[find(n)] for n, i in enumerate(ids)}


def test_near_duplicates(spark, empty):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    base = [random.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(random.randint(0, 6)):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(90 + i, " ".join(random.choice(words) for _ in range(random.randint(1, 40)))) for i in range(20)] + [(200, None), (201, ""), (202, "a b"), (203, "A, b!"), (203, "A, b!")]
    rows += [(300, "la " * 20000), (301, "la " * 19000 + "li"), (302, "la " * 9000)]
    d = spark.createDataFrame(rows, TEXTS).withColumn("class_id", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = minhash_dedup.report(d).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert minhash_dedup.report(empty).count() == 0 and minhash_dedup.one_each(empty).count() == 0
    named = minhash_dedup.report(spark.createDataFrame([("b", "x y z"), ("a", "X y z"), (None, "x Y z"), ("c", "other")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.class_id) for r in named) == [("", "a"), ("a", "a"), ("b", "a"), ("c", "c")]


def test_near_duplicates_recall(spark, sf_dir):
    """Links of the sf0.01 documents that are found, against all pairs."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = {r.doc_id: r.class_id for r in minhash_dedup.report(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    links = [(rows[i].doc_id, rows[j].doc_id) for i, j in brute_links([r.text for r in rows])]
    assert len(links) > 100 and sum(found[a] == found[b] for a, b in links) >= 0.99 * len(links)
    exact = brute_classes([(r.doc_id, r.text) for r in rows])
    assert all(exact[d] == exact[c] for d, c in found.items())


def test_a_hot_group_of_variants(spark):
    """A third of the texts are variants of one; many are too far from it, and near each other only in small families."""
    random.seed(11)
    words = [f"w{i}" for i in range(3000)]
    base, rows = [random.choice(words) for _ in range(100)], []
    for family in range(120):
        mine = list(base)
        for k in random.sample(range(100), 9):
            mine[k] = random.choice(words)
        for _ in range(random.choice([1, 1, 2, 3])):
            t = list(mine)
            t[random.randrange(100)] = random.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + i, " ".join(random.choices(words, k=100))) for i in range(400)]
    links = brute_links([t for _, t in rows])
    found = {r.doc_id: r.class_id for r in minhash_dedup.report(spark.createDataFrame(rows, TEXTS)).collect()}
    hit = [found[rows[i][0]] == found[rows[j][0]] for i, j in links]
    assert len(links) > 50 and sum(hit) >= 0.95 * len(links)
    # The exact mode finds every link, here and among texts of repeated words, whatever bands and estimates leave out.
    rows += [(5000 + i, " ".join(random.choices(["la", "li"], weights=[9, 1], k=random.randint(1, 60)))) for i in range(150)]
    exact = minhash_dedup.report(spark.createDataFrame(rows, TEXTS), exact=True).collect()
    assert {r.doc_id: r.class_id for r in exact} == brute_classes(rows)


def test_exact_pairs_without_any_band(spark):
    """With no components found before, the exact step alone finds all links."""
    random.seed(12)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(random.choices(words[: random.choice([1, 2, 40])], k=random.randint(1, 30))) for _ in range(150)]
    texts += [t + " more" for t in texts[:60]]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(bytes(f"{i:04d}", "ascii"), t) for i, t in enumerate(texts)], "row binary, text string")
    label = rows.selectExpr("row", "row as root")
    found = minhash_dedup.similar(minhash_dedup.untested(rows, label, 0.8), rows, 0.8).collect()
    assert {(int(r.a), int(r.b)) for r in found} == set(brute_links(texts)) and len(found) > 30


def test_groups_beyond_any_window(spark):
    """Links between texts far apart in every band's order, in groups that are compared in tiles: brute force on every pair."""
    random.seed(13)
    base = [f"w{i}" for i in range(100)]
    texts = set()
    for family in range(90):
        mine = list(base)
        for k in random.sample(range(100), 4):
            mine[k] = f"f{family}x{k}"
        texts.add(" ".join(mine))
    texts = sorted(texts | {f"{t} more" for t in sorted(texts)[:10]})
    rows = spark.createDataFrame([(bytes(f"{i:04d}", "ascii"), t) for i, t in enumerate(texts)], "row binary, text string")
    links = brute_links(texts)
    found = minhash_dedup.untested(rows, rows.selectExpr("row", "row as root"), 0.8).collect()
    assert {(int(r.a), int(r.b)) for r in found} >= {(i, j) for i, j in links if texts[j] == texts[i] + " more"}
    table = lambda n: pa.table({"i": [0] * n, "j": [0] * n, "block": [0] * n, "row": [b"%04d" % i for i in range(n)], "root": [b"%04d" % i for i in range(n)], "text": [t.encode() for t in texts[:n]]})
    few = minhash_dedup.tile_links(table(60), 0.8)
    assert {(int(a), int(b)) for a, b in zip(few["a"].to_pylist(), few["b"].to_pylist())} == {(i, j) for i, j in links if j < 60}
    same = minhash_dedup.report(spark.createDataFrame([(int(i), t) for i, t in enumerate(texts)], TEXTS)).collect()
    assert {r.doc_id: r.class_id for r in same} == brute_classes(list(enumerate(texts)))


def test_families_of_many_blocks(spark, monkeypatch):
    """With small groups and blocks, families take several tiles, and still all links are found."""
    monkeypatch.setattr(minhash_dedup, "TILE", 8)
    monkeypatch.setattr(minhash_dedup, "PAIRED", 2)
    random.seed(15)
    base = [f"w{i}" for i in range(100)]
    texts = set()
    for _ in range(60):
        mine = base[: random.randint(70, 100)]
        mine[random.randrange(70)] = random.choice("abcdefgh")
        texts.add(" ".join(mine))
    texts = sorted(texts)
    rows = spark.createDataFrame([(bytes(f"{i:04d}", "ascii"), t) for i, t in enumerate(texts)], "row binary, text string")
    links = brute_links(texts)
    found = [(int(r.a), int(r.b)) for r in minhash_dedup.untested(rows, rows.selectExpr("row", "row as root"), 0.8).collect()]
    assert len(links) > 100 and set(links) <= {(min(p), max(p)) for p in found}


def test_tiles_get_texts_that_can_be_linked(spark):
    """Of texts that share a passage, those whose counts by slots rule out any link are left out, no text of a link is, and each is sent once, however many elements it shares."""
    random.seed(14)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *random.choices([f"w{i}" for i in range(5000)], k=60)]) for _ in range(120)]
    texts += [f"{t} more" for t in texts[:3]] + [" ".join(["la"] * 200_000), " ".join(["la"] * 190_000)]
    rows = [b"%04d" % i for i in range(len(texts))]
    d = spark.createDataFrame([(r, r, t, len(minhash_dedup.elements(t.encode()))) for r, t in zip(rows, texts, strict=True)], "row binary, root binary, text string, total long")
    slots = {bytes(r.row): bytes(r.slots) for r in minhash_dedup.slot_counts(d).collect()}
    table = lambda j, block: pa.table({"i": [0] * len(rows), "j": [j] * len(rows), "block": block, "row": rows, "root": rows, "slots": [slots[r] for r in rows]})
    met = lambda t: {(int(a), int(b)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)}
    near = minhash_dedup.tile_near(table(0, [0] * len(rows)), 0.8)
    assert met(near) == {(0, 120), (1, 121), (2, 122), (123, 124)}
    assert met(minhash_dedup.tile_near(table(1, [int(i > 119) for i in range(len(rows))]), 0.8)) == {(0, 120), (1, 121), (2, 122)}
    sent = minhash_dedup.families(spark.createDataFrame(near.to_pylist(), "a binary, b binary"), d.select("row", "root", "total"), d, 0.8)
    assert sorted(int(r.row) for r in sent.where("i = j").collect()) == [0, 1, 2, 120, 121, 122, 123, 124]


def test_classes_of_string_ids_and_clashing_names(spark):
    d = spark.createDataFrame([("b", "x y z", "own"), ("a", "X y z", "own"), ("c", "other", "own")], "doc_id string, text string, row string")
    d = d.withColumns({c: F.col("row") for c in ("digest", "kept_id", "kept_row", "nth", "class_id", "keep")})
    for exact in (False, True):
        got = minhash_dedup.one_each(d, exact=exact)
        assert got.columns == d.columns and sorted((r.doc_id, r.nth) for r in got.collect()) == [("a", "own"), ("c", "own")]
        assert sorted((r.doc_id, r.class_id, r.keep) for r in minhash_dedup.report(d, exact=exact).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_one_of_each_class_where_ids_repeat(spark):
    random.seed(8)
    a, b, c, d = (" ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(40)) for _ in range(4))
    copy = f"{b} z"
    rows = [(3, b), (7, a), (7, copy), (7, b), (9, c), (9, d), (9, d), (10, d), (11, f"{c} z"), (11, c), (12, f"{a} y"), (12, f"{a} x"), (13, None), (13, ""), (None, a)]
    got = sorted((r.doc_id or 0, r.text or "") for r in minhash_dedup.one_each(spark.createDataFrame(rows, TEXTS)).collect())
    assert got == sorted([(3, b), (7, a), (9, c), (9, d), (13, ""), (0, a)])
    # Of two texts of one id in one class, one.
    twice = spark.createDataFrame([(1, f"{a} x"), (1, f"{a} y"), (2, a)], TEXTS)
    assert [r.doc_id for r in minhash_dedup.one_each(twice).collect()] == [1] and minhash_dedup.report(twice).where("keep").count() == 1


def test_quality_separates_junk(spark, sf_dir, empty):
    docs, gold = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs.select("doc_id", "text"), keep=["doc_id"]).join(gold, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.98 * len(good) and sum(not r.keep for r in bad) >= 0.9 * len(bad)
    odd = quality.classify(spark.createDataFrame([(0, None), (1, ""), (2, "!!! ***")], TEXTS)).collect()
    assert not any(r.keep for r in odd if r.doc_id < 2)
    assert quality.classify(empty).count() == 0


def test_bpe_equals_the_library(spark, sf_dir, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    random.seed(4)
    letters = "abcdefghij'ABCΣİßéñ  \n\t0123.,!<|>\x1ć中😀ﬁſ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(500)] + [None, "", "a<|endoftext|>b", "an" * 4000]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), TEXTS), VOCABULARY).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, VOCABULARY).count() == 0


def test_unit_dedup(spark, empty):
    line = "this line has more than five words."
    rows = [(2, f"start\n{line}\nend"), (1, f"{line}\n{line.upper()}\nshort"), (3, None), (4, ""), (5, "short\nshort"), (6, f"{line}"), (6, f"{line}")]
    got = {r.doc_id: r for r in unit_dedup.dedup(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got[1].kept == f"{line}\n\nshort" and got[2].kept == "start\n\nend" and got[2].removed[0].start == 6 and got[6].kept == ""
    assert got[3].n_bytes == 0 and got[5].kept == "short\nshort" and unit_dedup.dedup(empty).count() == 0


def test_unit_dedup_judges_length_not_only_words(spark):
    chinese, sentence = "今天的天气非常好我们一起去公园里散步吧", "one sentence that has as many as eight words"
    verse = "\n".join(["milk", "two eggs", "old bread", "red wine", "salt", "tea"])
    rows = [
        (1, f"开始\n{chinese}。\n结束"), (2, f"别的\n“{chinese}”\n完了"), (3, f"另一个。{chinese}。走吧"), (4, f"To buy today:\n{verse}\nbye"), (5, f"Quite another list\n{verse}\nand an end"),
        (6, f"{sentence}."), (7, f"Before it all. {sentence}. After."), (8, "Ann Lee\nMain 7\nUlm\n\nHello"), (9, "Dear all\n\nAnn Lee\nMain 7\nUlm\n\nBye"), (10, "so. so. so. so. so. so. so. so. so. so. so. so."),
    ]
    got = {r.doc_id: r.kept for r in unit_dedup.dedup(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got[1] == rows[0][1] and got[2] == "别的\n\n完了" and got[3] == "另一个。走吧" and got[4] == rows[3][1] and got[5] == "Quite another list\n\nand an end"
    assert got[7] == "Before it all. After." and got[9] == "Dear all\n\n\n\nBye" and got[10] == "so. "


def test_unit_dedup_takes_every_repeated_run_of_sentences():
    random.seed(6)
    make = lambda: [" ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(random.randint(1, 12))) + "." for _ in range(random.randint(1, 8))]
    for _ in range(300):
        passage, before = make(), "".join(x + random.choice(" \n") for x in make())
        texts = [(start + "".join(x + random.choice(" \n") for x in [*passage, *make()])).encode() for start in ("First of all. ", before)]
        first, (spans, digests) = set(unit_dedup.units_of(texts[0])[1]), unit_dedup.units_of(texts[1])
        gone = np.zeros(len(texts[1]), bool)
        for (lo, hi), d in zip(spans, digests, strict=True):
            if d in first:
                gone[lo:hi] = True
        if len(words_of(" ".join(passage).encode())) >= unit_dedup.SENTENCE_WORDS:
            assert all(gone[i] or chr(texts[1][i]).isspace() for i in range(len(before), len(before) + len(" ".join(passage))))


def test_shingles_of_many_texts_at_once():
    """Sets of many texts equal those of each alone: short and empty texts beside long ones, no shingle across two texts."""
    texts = [b"", b"a", b"a b", b"...", b"a b c d", b"a b c d e", b"A a\na  a a a a a", b"", "\u00e9 x \u00fc y z w".encode(), b"x y " * 900]
    value, count, begins = minhash_dedup.shingle_sets(texts)
    held, ends = minhash_dedup.element_sets(texts)
    assert begins[-1] == len(value) == len(count) and ends[-1] == len(held)
    for i, t in enumerate(texts):
        words = minhash_dedup.shingle_sets([t])
        assert (value[begins[i] : begins[i + 1]] == words[0]).all() and (count[begins[i] : begins[i + 1]] == words[1]).all()
        assert count[begins[i] : begins[i + 1]].sum() == ends[i + 1] - ends[i] == max(1, len(t.split()) - 4)
        assert (held[ends[i] : ends[i + 1]] == minhash_dedup.elements(t)).all()
    assert minhash_dedup.likeness(minhash_dedup.shingles(b"a b c d e f"), minhash_dedup.shingles(b"a b c d e g")) == 1 / 3
