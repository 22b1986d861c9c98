"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import canonical_rows, chat_digest, format_chat
from .collocations import collocations
from .common import read
from .decontamination import judged
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .html_extract import extract
from .language_id import languages
from .line_dedup import with_removed
from .minhash import near_duplicates
from .packing import pack, packing_digest
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filter import Rule, filter_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def tokenizer(name: str) -> str:
    """A tokenizer file, in `EVENTFLOW_TOKENIZERS` if that folder is set, else where the tokenizers package keeps it."""
    if folder := os.environ.get("EVENTFLOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_url_filter", """
with split as (
  select page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') raw_host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
hosts as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from split),
fits as (select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end rule from hosts)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end verdict from fits""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op2_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = with_removed(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return cleaned.select("doc_id", "text", F.size("removed").cast("long").alias("n_passages"), gone.alias("n_removed_words"))


@query("op3_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


@query("op4_html_extract", r"""
with articles as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) s from pages),
bare as (select page_id, url, regexp_replace(regexp_replace(s, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') s from articles),
plain as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'),
  '&gt;?', '>', 'g'), '&amp;?', '&', 'g') s from bare),
joined as (select page_id, url, trim(regexp_replace(s, '\s+', ' ', 'g')) s from plain)
select page_id, url, s as text, length(s)::bigint n_chars from joined""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_minhash", r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
sets as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from words),
sizes as (select doc_id, count(*) n from sets group by 1),
common as (select a.doc_id a, b.doc_id b, count(*) n from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
linked as (select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 85 * (x.n + y.n - c.n)),
edges as (select a u, b v from linked union all select b, a from linked),
reach as (select doc_id, doc_id other from sizes union select r.doc_id, e.v from reach r join edges e on e.u = r.other),
least as (select doc_id, min(other) c from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, d.doc_id) component_id, coalesce(c, d.doc_id) = d.doc_id kept
from documents d left join sizes using (doc_id) left join least using (doc_id)""")
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op6_decontamination", rf"""
with items as (select item_id::varchar item, w, least(13, len(w)) k from (select item_id, {WORDS} w from benchmark) where len(w) > 0),
sizes as (select distinct k from items),
wanted as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') s from (select item, w, k, unnest(range(1, len(w) - k + 2)) i from items)),
docs as (select doc_id, {WORDS} w from documents),
places as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') s from (
  select doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) i from docs, sizes)),
hits as (select p.doc_id, p.i, p.k, item from places p join wanted q on p.k = q.k and p.s = q.s),
covered as (select doc_id, count(distinct x) n from (select doc_id, unnest(range(i, i + k)) x from (select distinct doc_id, i, k from hits)) group by 1),
named as (select doc_id, count(*) n, string_agg(item, ',' order by item) ids from (select distinct doc_id, item from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(c.n, 0)::bigint n_hit, coalesce(m.n, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(c.n, 0) > 0 and 20 * coalesce(c.n, 0) >= len(w) contaminated
from docs left join covered c using (doc_id) left join named m using (doc_id)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    return judged(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_token_counts")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op8_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op9_chat_format", f"""
with turns as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') body from conversations
  union all select -1, 0, 'user', '{CONTROL}' union all select -1, 1, 'assistant', '{CONTROL}'),
escaped as (select *, length(replace(replace(role, '\\', '\\b'), '<|', '\\l|')) + length(role) - length(replace(role, chr(10), '')) r,
  length(replace(replace(body, '\\', '\\b'), '<|', '\\l|')) t, role = 'assistant' learnt from turns)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) turns_sha256,
  sum(case when learnt then length(body) else 0 end)::bigint loss_chars,
  sha256(coalesce(string_agg(case when learnt then body end, '' order by turn, role, body), '')) loss_sha256,
  sum(12 + r + 1 + t + 11)::bigint formatted_chars
from escaped group by conv_id""".replace("\\\\", "\\"))
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat_digest(format_chat(canonical_rows(turns.unionByName(own))))


@query("op10_exact_dedup", r"""
with texts as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') s from documents)
select doc_id, first_value(doc_id) over (partition by s order by n desc, doc_id) keep_id, count(*) over (partition by s) group_size,
  doc_id = first_value(doc_id) over (partition by s order by n desc, doc_id) kept, sha256(s) text_sha256
from texts""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
with own as (
  select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.id anchor, b.id other, a.lab = b.lab same, list_dot_product(a.q, b.q)::bigint s from own a join own b on a.id <> b.id where a.id % 50 = 0),
near as (select *, row_number() over (partition by anchor order by s desc, other) r from scored where same),
pairs as (select n.anchor, n.other p, n.s ps, x.other g, x.s gs, row_number() over (partition by n.anchor, n.other order by x.s desc, x.other) k
  from near n join scored x on x.anchor = n.anchor and not x.same and 50 * n.s <= 100 * x.s and 100 * x.s <= 95 * n.s where n.r <= 5)
select anchor anchor_id, p positive_id, k::int as rank, g negative_id, ps positive_score, gs negative_score from pairs where k <= 3""")
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


@query("op13_collocations", r"""
with pieces as materialized (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') w from (
    select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents)),
counts as materialized (select lang, g, k, count(*) f from (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') g from (
      select lang, w, k, unnest(range(1, len(w) - k + 2)) i from pieces, range(1, 5) t(k) where len(w) >= k)) group by all),
cand as materialized (select lang, g, k size, f, string_split(g, ' ') w from counts where k > 1 and f >= 30),
parts as (select lang, g, f, k, array_to_string(w[1:k], ' ') b, array_to_string(w[k + 1:], ' ') e from (select *, unnest(range(1, size)) k from cand)),
cuts as (select p.*, l.f l, r.f r, (2000000::hugeint * p.f // (l.f + r.f))::bigint score
  from parts p join counts l on l.lang = p.lang and l.g = p.b join counts r on r.lang = p.lang and r.g = p.e),
best as (select * from (select *, row_number() over (partition by lang, g order by score, k) o from cuts) where o = 1),
held as (select lang, g, max(f) m from (
  select lang, array_to_string(w[i:i + k - 1], ' ') g, f from (
    select lang, w, f, k, unnest(range(1, size - k + 2)) i from cand, range(2, 4) t(k) where size > k)) group by all),
sums as (select lang, sum(f)::bigint n from counts where k = 1 group by 1),
left_over as (select b.* from best b left join held h on h.lang = b.lang and h.g = b.g where h.m is null or 100 * h.m < 80 * b.f),
placed as (select *, row_number() over (partition by lang order by score desc, f desc, g) as place from left_over)
select p.lang, place as rank, g phrase, f a, l, r, n, score from placed p join sums using (lang) where place <= 2000""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
