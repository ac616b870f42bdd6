"""Clashing names, odd types and both paths of the corpus operators."""

import time
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate, license_scan, quality, secret_scan, suffix_dedup, topk_search, unit_dedup, url_filter

TEXTS = "doc_id long, text string"


def test_topk_slices_and_overflow(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))] + [(300, [0.0] * 4), (300, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("score", F.lit("clash"))
    one = sorted(map(tuple, topk_search.top_k(v, v.where("vec_id % 50 = 0"), "vec_id", "v").collect()))
    many = topk_search.top_k(v, v.where("vec_id % 50 = 0"), "vec_id", "v", block_rows=16, query_rows=2, slice_rows=32, slice_queries=3)
    assert sorted(map(tuple, many.collect())) == one and len(one) == 70
    big = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, v array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(big, big, "vec_id", "v").collect()


def test_decontamination_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "dd"), (3, None), (4, "x " * 30000 + "aa bb cc")], TEXTS)
    for c in ("items", "spans", "n_words", "row_key", "hit_from"):
        docs = docs.withColumn(c, F.lit("clash"))
    items = spark.createDataFrame([("i", "aa bb cc"), ("j", "bb cc"), ("k", "qq rr")], "item_id string, text string")
    for most in (32 << 20, 8):
        got = {r.doc_id: (r.n_words, r["items"], r["spans"], r.hit_from, r.hit_to) for r in decontaminate.find_windows(docs, items, most_bytes=most).collect()}
        assert got[1] == (3, ["i", "j"], "clash", [0], [3]) and got[2] == (1, [], "clash", [], []) and got[3][0] == 0 and got[4][3] == [30000]
    assert decontaminate.find_windows(docs.limit(0), items).count() == 0 and decontaminate.clean(docs.limit(0), items).count() == 0


def test_url_paths_agree(spark):
    urls = ["http://a.b.com/x/y", "http://b.com/" + "z" * 5000, "http://c.com/x", None, "", "http://.com/", "http://a.b.com/x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("best", F.lit("clash")).withColumn("lengths", F.lit("clash"))
    rules = spark.createDataFrame([("b.com", "/" + "z" * n, "block") for n in range(0, 4800, 1)] + [("b.com", "/x", "allow"), ("com", "", "block"), (None, "/", "block")], url_filter.RULES)
    a, b = (sorted(map(tuple, url_filter.judge(pages, rules, most_bytes=m).drop("url").collect())) for m in (32 << 20, 1))
    assert a == b and a[0][-2:] == ("b.com/x", "allow") and len(a[1][-2]) == 6 + 4799 and a[2][-2:] == ("com", "block") and a[3][-1] == "allow"
    for most in (32 << 20, 1):
        with pytest.raises(ValueError):
            url_filter.judge(pages, spark.createDataFrame([("b.com", "/", "deny")], url_filter.RULES), most_bytes=most)


def test_ledger_over_rule_versions(spark):
    key = "0123456789abcdef" * 2
    docs = [(1, f"token={key} " * 700), (2, "-----BEGIN PRIVATE KEY-----"), (3, None), (4, f"token={key} " * 700)]
    d = spark.createDataFrame(docs, TEXTS).withColumn("spans", F.lit("clash")).withColumn("blob", F.lit("clash"))
    whole = sorted(map(tuple, secret_scan.report(secret_scan.findings(*secret_scan.scan(d, "text")), "doc_id").collect()))
    _, ledger = secret_scan.advance(d, "text", None, secret_scan.BASE)
    # The ledger's places are those of the order in which its rules stood then.
    _, turned = secret_scan.advance(d, "text", None, secret_scan.BASE[::-1])
    for old in (ledger, turned):
        found, full = secret_scan.advance(d, "text", old, secret_scan.RULES)
        assert sorted(map(tuple, secret_scan.report(found, "doc_id").collect())) == whole
        assert full.count() == 3 * len(secret_scan.RULES) and full.where("rule = 'pem'").count() == 3
    assert whole[0][1] == 700 and whole[0][3] == 700 and whole[1][-1] == "pem:0:27"
    assert secret_scan.advance(d.limit(0), "text")[0].count() == 0 and secret_scan.redact(d.limit(0)).count() == 0
    safe = {r.doc_id: r.text for r in secret_scan.redact(d).collect()}
    assert safe[1] == "[SECRET] " * 700 and safe[3] is None


def test_licenses_keep_other_columns(spark):
    d = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (2, None)], TEXTS).withColumn("norm", F.lit("n")).withColumn("starts", F.lit(1)).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    got = license_scan.scan(d).collect()
    assert len(got) == 3 and {(r.norm, r.starts, json.dumps(r.tags), r.n_base) for r in got} == {("n", 1, '{"a": 1}', 1), ("n", 1, '{"a": 1}', 0)}
    assert license_scan.scan(d, keep=[]).count() == 3


def test_ids_that_are_no_integers(spark):
    d = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (suffix_dedup.report, unit_dedup.dedup):
        with pytest.raises(TypeError, match="integer"):
            f(d)


def test_dedup_with_clashing_columns(spark):
    line = "a line with more than five words in it"
    d = spark.createDataFrame([(1, line * 9), (2, line * 9), (None, line * 9)], TEXTS)
    for c in ("row", "doc", "found", "units", "n_bytes"):
        d = d.withColumn(c, F.lit("clash"))
    assert {r.doc_id: r.n_removed for r in suffix_dedup.report(d).collect()} == {1: 0, 2: 342, None: 342}
    assert {r.doc_id: r.n_removed for r in unit_dedup.dedup(d).collect()} == {1: 0, 2: 342, None: 342}


def test_label_model_against_brute_force(spark):
    """EM over vote patterns with counts equals EM over the single rows."""
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.7
    n = len(quality.LABELLERS)
    hit = rng.random((4000, n)) < rng.uniform(0.6, 0.95, n)
    votes = np.where(rng.random((4000, n)) < 0.3, 0, np.where(hit == truth[:, None], 1, -1))
    rows = ["".join("r-k"[v + 1] for v in r) for r in votes]
    counts = {r: rows.count(r) for r in set(rows)}
    model = quality.fit_labels(counts)
    right = [(model.posterior[r] >= 0.5) == t for r, t in zip(rows, truth, strict=True)]
    assert sum(right) >= 0.9 * len(right)
    # The same, one row and one labeller at a time.
    accuracy = [quality.PRIOR] * n
    for _ in range(100):
        agreed, voted = [quality.WORTH * quality.PRIOR] * n, [quality.WORTH] * n
        post = {}
        for r, times in counts.items():
            odds = 1.0
            for a, v in zip(accuracy, r, strict=True):
                odds *= {"k": a / (1 - a), "r": (1 - a) / a, "-": 1.0}[v]
            post[r] = odds / (1 + odds)
            for i, v in enumerate(r):
                if v != "-":
                    voted[i] += times
                    agreed[i] += times * (post[r] if v == "k" else 1 - post[r])
        accuracy = [min(max(a / b, 0.01), 0.999) for a, b in zip(agreed, voted, strict=True)]
    assert np.allclose([post[r] for r in counts], [model.posterior[r] for r in counts], atol=1e-6) and np.allclose(accuracy, list(model.accuracy.values()), atol=1e-6)


def test_scorer_fits_what_can_be_parted():
    rng = np.random.default_rng(6)
    x = rng.random((500, 20)) * (rng.random((500, 20)) < 0.5)
    y = (x[:, 0] + x[:, 1] > x[:, 2] + x[:, 3]).astype(float)
    w = quality.fit_scorer(x, y)
    assert (((x @ w[:-1] + w[-1]) > 0) == (y > 0.5)).mean() >= 0.93


def test_quality_with_odd_rows(spark):
    d = spark.createDataFrame([(1, "w " * 60000), (2, "same text here"), (2, "same text here"), (3, None)], TEXTS)
    for c in ("votes", "score", "keep", "weak"):
        d = d.withColumn(c, F.lit("clash"))
    got = quality.classify(d).collect()
    assert len(got) == 4 and len({(r.score, r.votes) for r in got if r.doc_id == 2}) == 1
    kept = quality.good(d)
    assert kept.columns == d.columns


def brute_units(rows):
    """The rule of unit_dedup, row by row: later places of equal normal forms go."""
    first, out = {}, {}
    placed = [(i, t.encode(), *unit_dedup.units_of(t.encode())) for i, t in sorted(rows)]
    for i, _, spans, digests in placed:
        for (lo, _), g in zip(spans, digests, strict=True):
            first.setdefault(g, (i, lo))
            first[g] = min(first[g], (i, lo))
    for i, t, spans, digests in placed:
        gone = np.zeros(len(t), bool)
        for (lo, hi), g in zip(spans, digests, strict=True):
            if first[g] != (i, lo):
                gone[lo:hi] = True
        out[i] = bytes(c for c, x in zip(t, gone.tolist(), strict=True) if not x).decode("utf-8", "replace")
    return out


def test_unit_dedup_against_brute_force(spark):
    rng = np.random.default_rng(4)
    lines = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], 6)) + "." for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for i in range(60)] + [(99, "")]
    got = {r.doc_id: r.kept for r in unit_dedup.dedup(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == brute_units(rows)


def test_secrets_grow_with_their_number(spark):
    """Ten times the matches of one text take at most 15 times as long, to find and to replace."""

    def seconds(n):
        text = " ".join(f"token=a{i:06d}b and" for i in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = secret_scan.report(secret_scan.findings(*secret_scan.scan(d, "text")), "doc_id").collect()
        scanned = time.perf_counter()
        (safe,) = secret_scan.redact(d).collect()
        done = time.perf_counter()
        assert r.n_assign == n and safe.text == " ".join(["[SECRET] and"] * n)
        return scanned - began, done - scanned

    seconds(1000)
    few, many = seconds(5000), seconds(50_000)
    assert many[0] <= 15 * few[0] and many[1] <= 15 * few[1], (few, many)


def test_marks_at_the_borders_of_pieces(spark):
    secret, texts = "token=abcdef", []
    for at in (secret_scan.PIECE - 20, secret_scan.PIECE - 6, secret_scan.PIECE - 12, secret_scan.PIECE, 3 * secret_scan.PIECE - 1):
        texts += ["é" * (at - 1) + " " + secret + " " + "🙂" * (2 * secret_scan.PIECE), " " * at + secret, secret + " " + "x" * at + " " + secret + "\n" + "AKIA" + "B" * 20]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    safe = {r.doc_id: r.text for r in secret_scan.redact(d).collect()}
    assert safe == {i: t.replace(secret, "[SECRET]").replace("AKIA" + "B" * 20, "[SECRET]") for i, t in enumerate(texts)}
