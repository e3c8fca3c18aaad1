"""The registered queries of this folder and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.llm import (
    bpe, decontaminate, divergence, fill_in_middle, html_extract, language_id, licenses, lm_score, maxscore, packing, quality,
    simhash, suffix_dedup,
)
from placewise.llm.common import crc_rest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(tables: str, sql: str | None = None):
    """Registers ``fn(whole table, ...) -> DataFrame`` under its own name."""
    def register(fn: Callable[..., DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()))
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


@query("embeddings", """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) e from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
      select q.vec_id query_id, c.vec_id vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from s)
    select query_id, cast(n as integer) rank, vec_id, score from r where n <= 20""")
def op1_topk_search(embeddings):
    return maxscore.topk_search(embeddings, F.col("vec_id") % 20 == 0)


@query("documents")
def op2_language_id(documents):
    rest = crc_rest("doc_id", 5)
    return language_id.predict_languages(documents, language_id.fit_models(documents.where(rest != 0)), rest == 0)


@query("documents")
def op3_bpe_codes(documents):
    import public_tokenizers

    return bpe.bpe_digests(documents, public_tokenizers.path("word_bpe_49k.json"))


@query("documents")
def op4_simhash_near_dedup(documents):
    return simhash.simhash_near_dedup(documents)


@query("pages")
def op5_html_extract(pages):
    return html_extract.extract_pages(pages, html_extract.fit_field(pages))


@query("documents")
def op6_suffix_dedup(documents):
    return suffix_dedup.suffix_dedup(documents)


@query("documents")
def op7_lm_score(documents):
    return lm_score.lm_scores(documents, crc_rest("doc_id", 7) == 2)


@query("documents")
def op8_license_scan(documents):
    return licenses.license_scan(documents)


@query("documents")
def op9_packing(documents):
    return packing.pack_batches(documents)


@query("documents", r"""
    with d as (
      select row_number() over () id, doc_id, coalesce(text, '') t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
    wl as (select id, x, y, length(y) c from (select id, unnest(range(1, len(w) + 1)) x, unnest(w) y from d)),
    a as (select id, cast(sum(c) as bigint) chars from wl group by id),
    l as (select id, unnest(string_split(t, chr(10))) s, unnest(range(len(string_split(t, chr(10))))) k from d),
    ll as (
      select id, coalesce(list_sum(list_transform(regexp_extract_all(s, '[^\x20\x09-\x0D]+'), lambda y: length(y))), 0) c,
             row_number() over (partition by id, s order by k) again from l where regexp_matches(s, '[^\x20\x09-\x0D]')),
    dl as (select id, count(*) n, cast(sum(c) as bigint) chars from ll where again > 1 group by id),
    m as (select unnest([5, 6, 7, 8, 9, 10]) n, unnest([0.25, 0.24, 0.23, 0.22, 0.21, 0.20]::double[]) most),
    ten as (
      select id, x, [y, lead(y, 1) over o, lead(y, 2) over o, lead(y, 3) over o, lead(y, 4) over o, lead(y, 5) over o,
        lead(y, 6) over o, lead(y, 7) over o, lead(y, 8) over o, lead(y, 9) over o] ten
      from wl window o as (partition by id order by x)),
    g as (select id, n, x k, array_to_string(ten[:n], ' ') g from ten, m where ten[n] is not null),
    r as (select id, n, k from g qualify count(*) over (partition by id, n, g) > 1),
    c as (select distinct id, n, unnest(range(k, k + n)) x from r),
    s as (
      select id, n, count(*) words, cast(sum(wl.c) as bigint) / any_value(a.chars) share
      from c join wl using (id, x) join a using (id) group by id, n),
    v as (
      select id, coalesce(max(words) filter (n = 8), 0) repeated, bool_or(share > most) above,
             first(n order by share desc, n) worst, max(share) worst_share from s join m using (n) group by id),
    o as (
      select doc_id, len(w) n_words, coalesce(a.chars, 0) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
             coalesce(dl.n, 0) n_dup_lines, coalesce(repeated, 0) n_repeat_words,
             coalesce(dl.chars, 0) / greatest(coalesce(a.chars, 0), 1) dup_line_char_share, coalesce(above, false) above,
             cast(coalesce(worst, 0) as integer) worst_ngram, cast(coalesce(worst_share, 0) as double) worst_ngram_share
      from d left join a using (id) left join dl using (id) left join v using (id))
    select * exclude (above), n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
           not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or above or dup_line_char_share > 0.20::double) kept from o""")
def op10_quality_rules(documents):
    return quality.quality_rules(documents)


@query("documents benchmark", r"""
    with d as (
      select row_number() over () id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
    b as (
      select cast(item_id as varchar) item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
    i as (
      select distinct item, unnest(case when len(w) < 10 then [w] else
        list_transform(range(1, len(w) - 8), lambda k: w[k:k + 9]) end) g from b where len(w) > 0),
    p as (select id, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct len(g) n from i) where len(w) >= n),
    h as (select id, k, n, item from p join i on w[k:k + n - 1] = g),
    c as (select id, count(distinct x) n_hit from (select id, unnest(range(k, k + n)) x from h) group by id),
    l as (
      select id, count(*) n_items, string_agg(item, ',' order by item) items
      from (select distinct id, item from h where item is not null) group by id)
    select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
           sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join c using (id) left join l using (id)""")
def op11_decontaminate(documents, benchmark):
    return decontaminate.contamination(documents, benchmark)


@query("documents", r"""
    with d as (
      select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
    c as (select id, lang, source, t, count(*) n from (select id, lang, source, unnest(w) t from d) group by all),
    l as (select lang, t, sum(n) n, count(*) docs from c group by all having count(*) >= 3),
    g as (select c.lang, source, t, sum(c.n) n from c join l using (lang, t) group by all),
    v as (select lang, count(*) v, cast(sum(n) as bigint) total from l group by lang),
    s as (
      select d.lang, d.source, coalesce(any_value(v.v), 0) v, coalesce(any_value(v.total), 0) lang_total,
             coalesce((select cast(sum(n) as bigint) from g where g.lang = d.lang and g.source = d.source), 0) total
      from (select distinct lang, source from d) d left join v using (lang) group by all),
    p as (
      select s.lang, s.source, l.t, coalesce(cast(g.n as bigint), 0) n,
             1 + 1000000000 * (coalesce(cast(g.n as bigint), 0) + 1) // (s.total + s.v) p,
             1 + 1000000000 * (cast(l.n as bigint) + 1) // (s.lang_total + s.v) q
      from s join l using (lang) left join g using (lang, source, t)),
    pairs as (
      select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f
      from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
    r as (
      select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) as value
      from s a join s b on a.lang = b.lang and a.source <> b.source
      left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
      union all
      select lang, source, 'term', t, (p - q) * (p - q) // q from p where n > 0 and p > q)
    select lang, source, part, item, value, cast(rank as integer) rank from (
      select *, row_number() over (partition by lang, source, part order by value desc, item) rank from r)
    where part = 'pair' or rank <= 200""")
def op12_source_divergence(documents):
    return divergence.source_divergence(documents)


@query("documents", r"""
    with d as (
      select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u,
             sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
    h as (
      select *, len(u) n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) r from d),
    c as (
      select *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100
                  then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end form from h),
    s as (
      select *, array_to_string(u[:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from c)
    select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars,
           case when form <> 'plain' then length(m) end middle_chars,
           sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                  else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
           sha256(t) restored_sha256 from s""")
def op13_fill_in_middle(documents):
    return fill_in_middle.fim_digests(documents)
