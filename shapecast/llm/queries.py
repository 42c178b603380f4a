"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_minhash(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op3_secrets(spark, sf_dir):
    from .secrets import digest, scan_secrets

    out = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    have = lambda c: F.size(F.filter("spans", lambda x: x[c])).cast("long").alias(f"n_{c}")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), have("copied"), have("live"))


def op4_katz(spark, sf_dir):
    from .katz import score_texts

    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    return score_texts(_table(spark, sf_dir, "documents"), train)


def op5_mix(spark, sf_dir):
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_licenses(spark, sf_dir):
    from .license_scan import scan_licenses

    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op7_quality(spark, sf_dir):
    from .quality import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).where("kept")


def op8_media(spark, sf_dir):
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def url_rules(spark):
    #: The rules of the query.
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    values = ", ".join("('" + "', '".join(x) + "')" for x in rules)
    return spark.sql(f"select * from values {values} as t(host, path, verdict)")


def op9_url_filter(spark, sf_dir):
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), url_rules(spark))


def op10_line_dedup(spark, sf_dir):
    from .line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"), "text")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_minhash, op3_secrets, op4_katz, op5_mix, op6_licenses, op7_quality, op8_media, op9_url_filter, op10_line_dedup)}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"



def _secrets_sql() -> str:
    """Matches and what is between them, whose lengths give the places."""
    from .secrets import KINDS

    parts = []
    for k, (name, quick, pattern, least) in enumerate(KINDS):
        p, q = (x.replace("'", "''") for x in (pattern, quick))
        value = f"regexp_extract_all(t, '{p}', 2)" if name == "assign" else f"regexp_extract_all(t, '{p}', 0)"
        parts.append(f"select rid, owner, {k} kind, '{name}' kname, {least} least, regexp_extract_all(t, '{p}', 0) m, {value} v, string_split_regex(t, '{p}') g from d where regexp_matches(t, '{q}')")
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(source, chr(1)) as owner, coalesce(text, '') t from documents),
     k as ({' union all '.join(parts)}),
     e as (select *, unnest(range(1, len(m) + 1)) i from k),
     x as (select rid, owner, kind, kname, list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0) s, len(m[i]) n, v[i] val from e where len(v[i]) >= least),
     f as (select val, count(distinct owner) owners from x group by val),
     y as (select x.*, kname || ':' || s::bigint || ':' || (s + n)::bigint as w, owners from x join f using (val)),
     a as (select rid, sum((kind = 0)::int) n0, sum((kind = 1)::int) n1, sum((kind = 2)::int) n2, string_agg(w, ',' order by s, kind) filter (kind < 3) b, string_agg(w, ',' order by s, kind) w, sum((owners >= 3)::int) c, sum((owners = 1)::int) l from y group by rid)
select doc_id, coalesce(n0, 0)::bigint n_assign, coalesce(n1, 0)::bigint n_access, coalesce(n2, 0)::bigint n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(w, '') spans, coalesce(c, 0)::bigint n_copied, coalesce(l, 0)::bigint n_live from d left join a using (rid)"""


ORACLES = {
    "op3_secrets": _secrets_sql(),
    "op1_decontaminate": f"""
with d as (select doc_id, {_WORDS} w from documents),
     b as (select coalesce(item_id::varchar, '') item, {_WORDS} w from benchmark),
     bw as (select item, least(len(w), 10) l, unnest(range(1, len(w) - least(len(w), 10) + 2)) s, w from b where len(w) > 0),
     wins as (select distinct item, l, array_to_string(w[s:s + l - 1], ' ') t from bw),
     lens as (select distinct l from wins),
     dw as (select doc_id, l, unnest(range(1, len(w) - l + 2)) s, w from d, lens where len(w) >= l),
     dt as (select doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') t from dw),
     hits as (select doc_id, item, s, l from dt join wins using (l, t)),
     words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + l)) p from hits) group by doc_id),
     its as (select doc_id, count(distinct item) n_items, sha256(string_agg(distinct item, ',' order by item)) h from hits group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join its using (doc_id)""",
    "op2_minhash": rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) w from documents),
     g as (select distinct doc_id, array_to_string(w[s:s + l - 1], ' ') t from (select doc_id, w, least(len(w), 4) l, unnest(range(1, len(w) - least(len(w), 4) + 2)) s from d where len(w) > 0)),
     n as (select doc_id, count(*) n from g group by doc_id),
     i as (select x.doc_id a, y.doc_id b, count(*) i from g x join g y using (t) where x.doc_id <> y.doc_id group by all),
     e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
     r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
     m as (select a, least(a, min(b)) c from r group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, doc_id) component_id, coalesce(c, doc_id) = doc_id kept
from d left join n using (doc_id) left join m on a = doc_id""",
    "op5_mix": r"""
with d as (select doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
     s as (select source, sum(size)::bigint source_size from d group by source),
     r as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w, source_size * 2.0::double lim, sum(source_size) over () * 1.5::double total from s),
     f as (select *, row_number() over (order by lim / w, source nulls last) k, sum(w) over () w_all from r),
     g as (select *, coalesce(sum(lim) over (order by k rows between unbounded preceding and 1 preceding), 0) lb, coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) wb from f),
     h as (select *, lim * (w_all - wb) <= w * (total - lb) is_full from g),
     t as (select *, case when is_full then lim else w * (total - sum(case when is_full then lim else 0 end) over ()) / sum(case when is_full then 0 else w end) over () end::double target from h),
     u as (select *, case when source_size > 0 then floor(target / source_size) else 0 end times from t),
     x as (select doc_id, size, source_size, target, times, target - times * source_size rest, sum(size) over (partition by d.source order by h) upto, sum(size) over (partition by d.source, h) n from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target, (size * (times + case when upto <= rest or (upto - n <= rest and upto - rest < rest - (upto - n)) then 1 else 0 end))::bigint taken from x""",
    "op9_url_filter": r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages),
     r(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     m as (select page_id, host, path, h || q as rule, v, row_number() over (partition by page_id, host, path order by length(h || q) desc nulls last, h || q desc) k from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
select page_id, host, path, rule, coalesce(v, 'allow') verdict from m where k = 1""",
}
