"""The registered queries of this subpackage and, where SQL can express them, their checking SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: The rules of the contract for URLs.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query
def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_dictionary"] = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), q as (
  select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p
), r as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as least from q
)
select page_id, payload_bytes, payload_digest, case when coalesce(page_id, least + 1) > least then 'revisit' else 'response' end as record_type,
  case when coalesce(page_id, least + 1) > least then least end as refers_to
from r"""


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.labelled_urls import labelled_urls
    from claimcheck.llm.url_filter import judge_urls

    labelled = spark.createDataFrame(labelled_urls(), "host string, path string, blocked boolean")
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, labelled)


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "words_deleted", F.sha2("text", 256).alias("text_sha256"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.mixing import label_quality, mix_sized, sized

    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    return mix_sized(label_quality(docs, table(spark, sf_dir, "labels")), F.col("_quality")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_mixing"] = r"""
with l as (
  select doc_id, max(quality) as q from labels where doc_id is not null group by doc_id
), d as (
  select d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    -ln((('0x' || left(md5('0:' || coalesce(d.doc_id::varchar, 'null')), 13))::bigint + 1)::double / 4503599627370497.0)
      / case l.q when 1 then 2.0 when 0 then 0.5 else 1.0 end as key
  from documents d left join l on l.doc_id = d.doc_id
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight, 3.0::double * source_size as bound from s
), r as (
  select *, bound / weight as ratio from w
), v as (
  select *, (sum(source_size) over () - coalesce(sum(bound) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level
  from r
), t as (
  select *, least(bound, (max(level) filter (where level <= ratio) over ()) * weight) as target from v
), u as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t
), f as (
  select d.doc_id, d.size, u.source_size::bigint as source_size, u.target, u.epochs, u.target - u.epochs * u.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0) as earlier
  from d join u on d.source is not distinct from u.source
)
select doc_id, size, source_size, target, ((epochs + case when 2 * earlier + size <= 2 * rest then 1 else 0 end) * size)::bigint as taken from f"""


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.chat import canonical_turns, format_turns, read_loss, read_turns

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    probe = F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(says).alias("text")) for k, role in enumerate(("user", "assistant")))))
    turns = turns.union(spark.range(1).select(probe.alias("p")).select("p.*"))
    asked = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    records = turns.groupBy("conv_id").agg(F.transform(asked, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("t"))
    two = (F.size("t") == 2) & (F.get("t", F.lit(0))["role"] == "user") & (F.get("t", F.lit(1))["role"] == "assistant")
    pair = F.to_variant_object(F.struct(F.get("t", F.lit(0))["text"].alias("prompt"), F.get("t", F.lit(1))["text"].alias("response")))
    chat = F.to_variant_object(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    formatted = format_turns(canonical_turns(records.select("conv_id", F.when(two, pair).otherwise(chat).alias("record")))).select("conv_id", "formatted", "mask")
    read = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("mask"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op6_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as x from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<\n]', '', 'g')) + 14 as chars from c
), g as (
  select conv_id, count(*) as n_turns, sum(chars)::bigint as formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, x nulls first) as lines,
    coalesce(string_agg(text, '' order by turn nulls first, r nulls first, x nulls first) filter (where role = 'assistant'), '') as loss
  from e group by conv_id
)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op8_decontamination"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), i as (
  select distinct item_id, least(len(w), 13) as size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda k: array_to_string(w[k:k + least(len(w), 13) - 1], ' '))) as win
  from b where len(w) > 0
), z as (select distinct size from i), g as (
  select doc_id, z.size, k as pos, array_to_string(w[k:k + z.size - 1], ' ') as win
  from d, z, unnest(range(1, len(w) - z.size + 2)) as u(k)
), m as (
  select g.doc_id, g.pos, g.size, i.item_id from g join i on i.size = g.size and i.win = g.win
), h as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as p from m) group by doc_id
), t as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""


@query
def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op10_quality_cascade"] = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select doc_id, text, w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), g as (
  select doc_id, k, array_to_string(w[k:k + 7], ' ') as win from d, unnest(range(1, len(w) - 6)) as u(k)
), r as (
  select doc_id, k from (select *, count(*) over (partition by doc_id, win) as c from g) where c > 1
), c as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + 8)) as p from r) group by doc_id
), m as (
  select l.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines) as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) as stutter
  from l left join c on c.doc_id = l.doc_id
), v as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 30 * n_words or word_chars < 2 * n_words or word_chars > 14 * n_words or 2 * n_dup_lines > n_lines or 100 * stutter > 30 * n_words) as kept
from v"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.trie import numbered_turns, prefix_trie, with_shared_openings

    return prefix_trie(with_shared_openings(numbered_turns(table(spark, sf_dir, "conversations")), group=5, openings=9))


ORACLES["op12_prefix_trie"] = r"""
with k as (
  select conv_id, turn, strlen(coalesce(text, '')) as bytes, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key from conversations where conv_id is not null
), t as (
  select *, row_number() over (partition by conv_id order by turn nulls first, key) - 1 as pos from k
), g as (
  select conv_id as c, count(*) as n, conv_id - conv_id % 5 as base, xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda s: unicode(s)::bigint),
    lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295), 4294967295) % 9 as h
  from t group by conv_id
), c as (
  select g.*, least(g.h, coalesce(b.n, 0)) as m from g left join g b on b.c = g.base
), r as (
  select c, pos - h + m as pos, key, bytes from t join c on c.c = t.conv_id where pos >= h
  union all select c, pos, key, bytes from c join t on t.conv_id = c.base where pos < h
), s as (
  select c.c, coalesce(list(key order by pos) filter (key is not null), []) as keys, coalesce(list(bytes order by pos) filter (key is not null), []) as sizes from c left join r on r.c = c.c group by c.c
), p as (
  select c, d, array_to_string(keys[:d], ' ') as path, array_to_string(keys[:greatest(d, 1) - 1], ' ') as up, keys, case when d > 0 then sizes[d] else 0 end as bytes, len(keys) as n from s, unnest(range(0, len(keys) + 1)) as u(d)
), v as (
  select d, path, min(c) as conv_id, any_value(up) as up, count(*) as n_convs, any_value(bytes) as bytes, any_value(keys) as keys, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256 from p group by d, path
), e as (
  select a.*, count(b.path) as n_children from v a left join v b on b.d = a.d + 1 and b.up = a.path group by all
), z as (
  select a.d, a.path, count(*) filter (e.n_children = 0) as n_leaves, sum((e.n_convs - 1) * e.bytes)::bigint as saved from e, unnest(range(0, e.d + 1)) as u(x), v a where a.d = u.x and a.path = array_to_string(e.keys[:u.x], ' ') group by all
)
select e.conv_id, e.d as depth, w.conv_id as parent_conv_id, e.n_convs, e.n_children, z.n_leaves, z.saved as saved_tokens, e.ends_sha256
from e join z on z.d = e.d and z.path = e.path left join v w on w.d = e.d - 1 and w.path = e.up"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimcheck.llm.alignment import alignment_stats

    return alignment_stats(table(spark, sf_dir, "documents").select("doc_id", "text"))
