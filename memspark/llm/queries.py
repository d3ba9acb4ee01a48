"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, filter_audit, html_main, line_dedup, merkle, ngram_join, oph_dedup, packing, quality_bt, toxic_cnn, url_cascade, warc, weak_rules
from .common import table, tokenizer_path

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match", "longest_match_at")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_cnn.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph_dedup.near_copies(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_cascade": op2_url_cascade,
    "op3_ngram_join": op3_ngram_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_main": op5_html_main,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op11_near_dedup": op11_near_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_url_cascade"] = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(verdict, h, q) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m as (
  select page_id, arg_max(h || q, length(h || q)) as rule, arg_max(verdict, length(h || q)) as verdict
  from p join r on (host = h or suffix(host, '.' || h)) and starts_with(path, q)
  group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from p left join m on p.page_id = m.page_id
"""

ORACLE_SQL["op4_line_dedup"] = """
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split)),
f as (select key, min(doc_id) as first_doc from l where length(key) >= 10 group by key)
select l.doc_id, count(*) as n_lines,
       count(*) filter (first_doc <> l.doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos)
                       filter (first_doc is null or first_doc = l.doc_id), '')) as kept_sha256
from l left join f on l.key = f.key
group by l.doc_id
"""

ORACLE_SQL["op8_warc"] = """
with q as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages),
g as (
  select payload_digest as digest, max(page_id) as owner from q where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
       case when owner is null or owner = page_id then 'response' else 'revisit' end as record_type,
       case when owner <> page_id then owner end as refers_to
from q left join g on payload_digest = digest and payload_bytes >= 1000
"""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL["op3_ngram_join"] = f"""
with recursive d as (select doc_id, {WORDS} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as shingle
      from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n, md5(string_agg(shingle, '|' order by shingle)) as print from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where shared >= 0.8 * (x.n + y.n - shared) - 1e-6),
w(id, other) as (select a, b from l union select w.id, l.b from w join l on w.other = l.a),
c as (select id, least(id, min(other)) as class_id from w group by id),
k as (select a as id, count(*) as links from l group by a)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id,
       coalesce(min(d.doc_id) over (partition by print), d.doc_id) as copy_id, coalesce(links, 0) as n_links
from d join n on d.doc_id = n.doc_id left join c on d.doc_id = c.id left join k on d.doc_id = k.id
union all select doc_id, doc_id, doc_id, 0 from d where len(ws) = 0
"""

ORACLE_SQL["op6_decontamination"] = f"""
with d as (select doc_id, {WORDS} as ws from documents), b as (select item_id, {WORDS} as ws from benchmark),
v as (select item_id, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as w, least(10, len(ws)) as n
      from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
sizes as (select distinct n from v),
t as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as w
      from (select doc_id, ws, n, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) as i from d, sizes)),
m as (select distinct doc_id, i, t.n, item_id from t join v on t.w = v.w and t.n = v.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
x as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join x using (doc_id)
"""

ORACLE_SQL["op11_near_dedup"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as shingle
      from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
w(id, other) as (select a, b from l union select w.id, l.b from w join l on w.other = l.a),
c as (select id, least(id, min(other)) as component_id from w group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n on d.doc_id = n.doc_id left join c on d.doc_id = c.id
"""


def merkle_sql(high: int = 6, wide: int = 3) -> str:
    """The manifest by recomputed ancestors: runs of eight as strings a level, a leaf's place in each from its rank alone.
    Enough for 8^high documents a language and 8^wide languages."""
    enc = lambda c, v: f"case when {c} is null then '-' else octet_length(encode({v}::varchar)) || ':' || {v}::varchar end"
    head = " || ".join(enc(c, c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten([[(ord(x) >> k) & 1 for k in range(8)] for x in string_split(doc_id::varchar, '')])"
    crc = f"xor(list_reduce([4294967295::bigint] || {bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

    def tree(x: str, t: str, levels: int) -> str:
        return ", ".join(
            f"""{t}{k} as (select g, i // 8 as p, string_agg(h, '' order by i) as run, any_value(n) as n from {x}{k} where n > 1 group by all),
            {x}{k + 1} as (select g, p as i, (n + 7) // 8 as n, sha256(run) as h from {t}{k})"""
            for k in range(levels)
        )

    def last(x: str, levels: int) -> str:
        return " union all ".join(f"select g, h from {x}{k} where n = 1" for k in range(levels + 1))

    ctes = [
        f"""a as (select doc_id, lang is not null as known, lang, sha256({head} || {enc('text', 'text')}) as leaf,
                 case when {crc} % 3 = 0 then sha256({head} || {enc('text', low)}) end as tampered from documents)""",
        """b as (select *, dense_rank() over (order by known, encode(lang)) - 1 as g from a)""",
        """x0 as (select g, row_number() over (partition by g order by doc_id) - 1 as i, count(*) over (partition by g) as n, leaf as h, doc_id, tampered from b)""",
        tree("x", "t", high),
        f"s as ({last('x', high)})",
        "y0 as (select 0 as g, s.g as i, count(*) over () as n, h from s)",
        tree("y", "u", wide),
        f"root as ({last('y', wide)})",
        "f0 as (select x0.g, i, doc_id, x0.h as leaf, coalesce(tampered, x0.h) as acc, '' as sib from x0)",
    ]
    steps = [(f"t{k}", "f.g", f"i // {8**k}") for k in range(high)] + [(f"u{k}", "0", f"f.g // {8**k}") for k in range(wide)]
    for k, (t, g, at) in enumerate(steps):
        cut = f"substr(run, 1, (({at}) % 8) * 64)", f"substr(run, (({at}) % 8) * 64 + 65)"
        ctes.append(f"""f{k + 1} as (select f.g, i, doc_id, leaf, case when run is null then acc else sha256({cut[0]} || acc || {cut[1]}) end as acc,
            sib || coalesce({cut[0]} || {cut[1]}, '') as sib from f{k} f left join {t} t on t.g = {g} and t.p = ({at}) // 8)""")
    return f"""with {", ".join(ctes)}
        select doc_id, leaf, s.h as subroot, root.h as root, sha256(sib) as proof_sha256, acc as folded_root, acc = root.h as verified,
               (select count(*) from (select unnest([{", ".join(f"(select count(*) from t{k} where t{k}.g = f.g)" for k in range(high))}]) as c) where c > 0)
               + (select count(*) from (select unnest([{", ".join(f"(select count(*) from u{k})" for k in range(wide))}]) as c) where c > 0) as n_levels
        from f{len(steps)} f join s on s.g = f.g, root"""


ORACLE_SQL["op12_merkle_manifest"] = merkle_sql()

ORACLE_SQL["op13_filter_audit"] = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
f as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
         {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': min(w.doc_id) over (partition by text) < w.doc_id} as x
  from w left join labels on w.doc_id = labels.doc_id),
g as (
  select part, [k for k in ['A', 'B', 'C', 'D', 'E'] if case k when 'A' then x.A when 'B' then x.B when 'C' then x.C when 'D' then x.D else x.E end] as fails,
         count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from l a, l b, l c, l d, l e
  where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (
  select g.part, filter_order, step, filter_order[step] as filter, n, good, toxic, fails,
         list_contains(fails, filter_order[step]) as failed,
         len([k for k in fails if strpos(filter_order, k) < step]) > 0 as gone
  from g, o, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step::int as step, filter,
         sum(n) filter (not failed and not gone) as kept, sum(n) filter (failed and not gone) as removed,
         sum(n) filter (failed and gone) as redundant, sum(n) filter (failed and len(fails) = 1) as unique_fails,
         sum(good) filter (failed and not gone) as good_lost, sum(toxic) filter (failed and not gone) as toxic_lost
  from s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, filter), 0)::bigint as shapley
from r
"""
