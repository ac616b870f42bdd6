"""op11 against its library, op12 against its SQL on difficult rows, op13 against a loop over all lags."""

import hashlib
import random
import zlib

import duckdb
import pytest
import sentencepiece

from sheetloom.llm import filter_audit, periodic_runs, queries, token_counts

MODEL = queries.vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, n_tokens string, runs int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def difficult():
    random.seed(31)
    bits = [" ", "  ", "▁", "a", "b", "é", "é", "ﬁ", "\n", "\t", "<s>", "</s>", "<0x41>", "<unk>", "the", "Ing", "中文", "日本", "🙂", "\x00", "\r\n", "....", "1999", "ü", "ing", "\x85", " "]
    return ["", " ", "a", "\n", *("".join(random.choice(bits) for _ in range(random.randrange(14))) for _ in range(1500)), "a" * 30_000, "中" * 20_000, " " * 5_000, "the " * 5_000, "x\n" * 9_000]


def test_tokens_equal_the_library(spark, library):
    texts = difficult()
    rows = [(i, t, None, "own", 1) for i, t in enumerate(texts)] + [(None, None, "x", "own", 2), (1, texts[1], "x", "own", 3)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, DOCS), MODEL).collect()
    assert sorted(got[0].asDict()) == sorted(["doc_id", "text", "lang", "runs", "n_bytes", "n_tokens", "over_limit", "n_whole"]) and len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096) and r.n_whole <= n
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), MODEL).count() == 0


def test_every_proven_string_is_one_token(library):
    whole = token_counts.proven(token_counts.load(MODEL))
    assert len(whole) > 10_000 and all(len(library.encode(s[1:])) == 1 for s in whole if s[1:] and s[1] != token_counts.MARK)


def test_short_and_long_merges_agree():
    scores = token_counts.load(MODEL)
    random.seed(32)
    for _ in range(300):
        part = "".join(random.choice("▁thein.,1é") for _ in range(random.randrange(1, 40)))
        assert token_counts.merged(part, scores) == token_counts.merged_by_heap(part, scores)


def test_tokens_of_a_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t)) for i, t in texts.items()}


def test_audit_of_difficult_rows(spark, tmp_path):
    random.seed(33)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", "short", long, long + " $", "AB " * 100 + long, "word " * 250, long.upper(), "é " * 300 + "&", "# A"]
    # Ids and texts repeat, ids are null, parts are null or empty.
    rows = [(random.choice([None, *range(25)]), random.choice(texts), random.choice([None, "", "en", "de"]), "own", 1) for _ in range(300)]
    marks = [(random.choice([None, *range(25)]), random.choice([None, 0, 1]), random.choice([None, 0, 1]), "x") for _ in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(docs, labels).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({c: "Int64" for c in ("doc_id", "quality", "toxic")}))
    want = con.execute(queries.OP12).df()
    by = ["part", "filter_order", "step"]
    a, b = (x.sort_values(by).reset_index(drop=True)[sorted(want.columns)].astype({"part": str}) for x in (got, want))
    assert len(a) == 3 * 600 and (a == b).all().all()
    assert (a.kept + a.removed == a.groupby(["part", "filter_order"]).kept.shift(fill_value=0).where(a.step > 1, a.part.map(docs.toPandas().lang.fillna("").value_counts()))).all()
    assert filter_audit.audit(docs.limit(0), labels).count() == 0 and filter_audit.audit(docs, labels.limit(0)).count() == 1800


def test_fields_do_not_run_over():
    n = 1 << 40
    total = sum(n * filter_audit.packed(m) for m in range(filter_audit.MASKS))
    rows = filter_audit.unpacked(total.to_bytes(filter_audit.WIDTH, "little"))
    # Over all masks, half fail a filter; the first step removes them, the last keeps one of 32.
    assert rows[0][:3].tolist() == [64 * n, 64 * n, 0] and rows[4][0] == 4 * n and rows.shape == (600, 7)


def plain_runs(w):
    """All lags, all stretches, all smaller periods."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic(seed, count):
    random.seed(seed)
    for _ in range(count):
        few = [str(x) for x in range(random.choice([1, 2, 3, 5, 12]))]
        w = [random.choice(few) for _ in range(random.randrange(40))]
        for _ in range(random.randrange(3)):
            cycle = [random.choice(few) for _ in range(random.randrange(1, 12))]
            i = random.randrange(len(w) + 1)
            w[i:i] = (cycle * 9)[: random.randrange(3 * len(cycle), 9 * len(cycle) + 1)]
        yield random.choice([" ", "\n", "\t \x0b"]).join(w)


def test_runs_equal_the_loop(spark):
    texts = [*periodic(34, 600), "", " ", "a " * 5, "a " * 6, "a b " * 3, "A a " * 4, "é\x85é " * 7, "x" * 10_000]
    rows = [(i, t, "en", "own", 1) for i, t in enumerate(texts)] + [(None, None, None, "own", 1), (0, texts[0], "en", "own", 1)]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and sum(len(r.runs) > 1 for r in got) > 50
    for r in got:
        w = [x.decode() for x in (texts[r.doc_id] if r.doc_id is not None else "").encode().split()]
        want = plain_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == want and r.collapsed == plain_kept(w, want)
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_few_rounds_of_splitting_give_the_same_runs(monkeypatch):
    texts = [t.encode().split() for t in periodic(35, 200)]
    full = [r.tolist() for r in periodic_runs.runs_of(texts)]
    for rounds in (1, 2):
        monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
        assert [r.tolist() for r in periodic_runs.runs_of(texts)] == full


def test_a_very_long_text_is_scanned_whole():
    cycle = [b"%d" % i for i in range(20_000)]
    (runs,) = periodic_runs.runs_of([[b"first", *cycle * 4, *cycle[:7], b"last"]])
    assert runs.tolist() == [[1, 80_007, 20_000]]


def test_runs_of_a_table(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    docs, some = spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), 0
    for d in docs:
        w, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if len(w) > 1500:
            continue
        w = [x.decode() for x in w]
        runs, r = plain_runs(w), got[d.doc_id]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        some += bool(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(plain_kept(w, runs).encode()).hexdigest()
    assert len(got) == len(docs) and some > 5
