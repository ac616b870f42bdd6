"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import bpe, decontaminate, filter_audit, license_scan, minhash_dedup, periodic_runs, quality, secret_scan, suffix_dedup, token_counts, topk_search, unit_dedup, url_filter


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies; TOKENIZER_DIR names another folder."""
    own = os.environ.get("TOKENIZER_DIR")
    return os.path.join(own, name) if own else public_tokenizers.path(name)


#: The rules that op3 judges by: host, path, verdict.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]), "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, keep=["page_id"])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The base rules' run leaves a ledger; the run with all rules scans what that ledger lacks.
    _, ledger = secret_scan.advance(docs, "text", None, secret_scan.BASE)
    found, _ = secret_scan.advance(docs, "text", ledger, secret_scan.RULES)
    return secret_scan.report(found, "doc_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.report(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.report(unit_dedup.dedup(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, vocabulary(), keep=["doc_id"], digests=True)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def cycled(doc_id: int | None, text: bytes) -> bytes:
    """The text in which the query looks for runs: of every tenth id or so, the words from one place on become a cycle."""
    h = zlib.crc32(str(doc_id).encode())
    words = text.split() if doc_id is not None and h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in ((b.column(0), b.column(1)) for b in batches):
            made = [cycled(i.as_py(), t.as_py()) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["doc_id", "text"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return periodic_runs.find_runs(docs.mapInArrow(run, "doc_id long, text binary"), keep=["doc_id"], digests=True)


def queries() -> dict:
    each = (
        op1_topk_search, op2_decontaminate, op3_url_filter, op4_secret_scan, op5_license_scan, op6_suffix_dedup, op7_minhash_dedup, op8_quality, op9_bpe, op10_unit_dedup,
        op11_token_counts, op12_filter_audit, op13_periodic_runs,
    )
    return {f.__name__: f for f in each}


OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id, min(v) as v from v where vec_id % 100 = 0 group by vec_id),
s as (
  select q.vec_id as query_id, v.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) as bigint) as score
  from q join v on q.vec_id <> v.vec_id and len(q.v) = len(v.v)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10
"""

OP2 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
pos as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win))),
hit as (select distinct pos.doc_id, pos.n, pos.i, win.item_id from pos join win using (n, gram)),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from (select distinct doc_id, n, i from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, cast(item_id as varchar) as name from hit where item_id is not null) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

OP3 = r"""
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
u as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules (h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
f as (
  select page_id, arg_max({'rule': h || p, 'v': v}, [length(h || p), length(h)]) as best
  from u join rules on (host = h or host like '%.' || h) and starts_with(path, p) group by page_id)
select page_id, host, path, best.rule as rule, coalesce(best.v, 'allow') as verdict from u left join f using (page_id)
"""


def _op4() -> str:
    """The same spans from the pieces between matches."""
    parts, names = [], []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        judged = f"regexp_extract_all(t, '{pattern}', {rule.group})"
        parts.append(f"""
m{place} as (select doc_id, t, regexp_extract_all(t, '{pattern}') as whole, {judged} as judged, regexp_split_to_array(t, '{pattern}') as pieces from d where regexp_matches(t, '{pattern}')),
s{place} as (select doc_id, {place} as place, '{rule.kind}' as kind,
    list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as b,
    length(whole[i]) as n from (select *, unnest(range(1, len(whole) + 1)) as i from m{place}) where length(judged[i]) >= {rule.least})""")
        names.append(f"select * from s{place}")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),{",".join(parts)},
a as (select doc_id, place, kind, cast(b as bigint) as b, cast(b + n as bigint) as e from ({" union all ".join(names)})),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || b || ':' || e, ',' order by b, place) filter (place < 3) as base, string_agg(kind || ':' || b || ':' || e, ',' order by b, place) as spans from a group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""


def _op5() -> str:
    """Bigrams joined to the notices, diagonals counted, neighbours merged, all in SQL."""
    rows = []
    for t, (notice, label) in enumerate((*license_scan.PHRASES, *license_scan.NOTICES)):
        w = notice.split()
        rows += [f"({t}, '{label}', {len(w) - 1}, {i}, '{w[i]} {w[i + 1]}')" for i in range(len(w) - 1)]
    n, drift, accept = len(license_scan.PHRASES), license_scan.DRIFT, license_scan.ACCEPT
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t (template, label, total, tpos, gram) as (values {", ".join(rows)}),
g as (select doc_id, i - 1 as pos, w[i] || ' ' || w[i + 1] as gram from (select doc_id, w, unnest(range(1, len(w))) as i from d)),
v as (select doc_id, template, label, total, pos, tpos from g join t using (gram)),
diag as (select doc_id, template, label, total, pos - tpos as diag, list(distinct tpos) as held, min(pos) as first, max(pos) as last from v group by doc_id, template, label, total, pos - tpos),
m as (select *, case when first - lag(last) over w > {drift + 1} or abs(diag - lag(diag) over w) > {drift} or lag(last) over w is null then 1 else 0 end as new from diag
  window w as (partition by doc_id, template order by first, diag)),
sp as (select *, sum(new) over (partition by doc_id, template order by first, diag rows unbounded preceding) as span from m),
u as (select doc_id, template, label, total, span, len(list_distinct(flatten(list(held)))) / total as share, count(*) filter (len(held) = total) as places,
    min(diag) filter (len(held) = total) as first_place, max(diag) filter (len(held) = total) as last_place from sp group by doc_id, template, label, total, span),
r as (select doc_id, sum(places) filter (template < {n}) as n_base, min(first_place) filter (template < {n}) as first_word, max(last_place) filter (template < {n}) as last_word,
    string_agg(distinct label, ',' order by label) filter (template < {n} and places > 0) as base_labels,
    string_agg(distinct label, ',' order by label) filter ((template < {n} and places > 0) or (template >= {n} and share >= {accept})) as labels, max(share) as score from u group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6) as score from d left join r using (doc_id)
"""


#: Masks counted by part, then all orders and steps over them.
OP12 = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as lead from documents),
l as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id),
m as (
  select part, len(w) < 200 as fa, 100 * len(list_distinct(w)) < 50 * len(w) as fb, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as fc,
    regexp_matches(t, '[#$%&*|]') as fd, coalesce(doc_id > lead, false) as fe, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from d left join l using (doc_id)),
c as (select part, [fa, fb, fc, fd, fe] as f, good, toxic, count(*) as n from m group by all),
x (k) as (select unnest(range(1, 6))),
o as (
  select [a.k, b.k, c.k, d.k, e.k] as o from x a, x b, x c, x d, x e
  where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select part, o, k as step, o[k] as own, list_bool_or(list_transform(o[1 : k - 1], lambda i: f[i])) as gone, f, good, toxic, n from c, o, x),
r as (
  select part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') as filter_order, step, own,
    coalesce(sum(n) filter (not coalesce(gone, false) and not f[own]), 0) as kept, coalesce(sum(n) filter (not coalesce(gone, false) and f[own]), 0) as removed,
    coalesce(sum(n) filter (coalesce(gone, false) and f[own]), 0) as redundant, coalesce(sum(n) filter (f[own] and len(list_filter(f, lambda b: b)) = 1), 0) as unique_fails,
    coalesce(sum(n) filter (not coalesce(gone, false) and f[own] and good), 0) as good_lost, coalesce(sum(n) filter (not coalesce(gone, false) and f[own] and toxic), 0) as toxic_lost
  from s group by part, o, step, own)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1, "op2_decontaminate": OP2, "op3_url_filter": OP3, "op4_secret_scan": _op4(), "op5_license_scan": _op5(), "op12_filter_audit": OP12}
