"""The registered query of each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelyard.llm import (bpe_codec, decontaminate, filter_audit, licences, line_dedup, near_dedup, packing, pii, quality,
                            sharding, substring_dedup, vector_codes, warc)
from funnelyard.llm.common import stage
from funnelyard.llm.registry import ORACLES, QUERIES, register  # noqa: F401
from funnelyard.sources.tables import read_table


def _sql_sentence_id(sentence: str) -> str:
    """DuckDB text of `licences.sentence_id`."""
    words = f"regexp_replace(translate({sentence}, '{licences._UPPER}', '{licences._LOWER}'), '[^a-z0-9.]+', ' ', 'g')"
    words = f"regexp_replace({words}, '^[ .]+|[ .]+$', '', 'g')"
    cases = " ".join(f"when regexp_matches({words}, '^(?:{pattern})$') then '{name}'" for name, pattern in licences.SENTENCES)
    return f"case {cases} end"


def _sql_rules() -> str:
    """One step for each rule, in order: m0 -> m1 -> ..."""
    steps = []
    for k, (name, seq) in enumerate(licences.RULES):
        tokens = licences._tokens(seq)
        steps.append(f"m{k + 1} as materialized (select r, replace(s, '{tokens}', '<=>') as s, case when contains(s, '{tokens}') and not list_contains(found, '{name}') "
                     f"then list_append(found, '{name}') else found end as found from m{k})")
    return ",\n".join(steps)


OP1_SQL = f"""
with d as materialized (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as (
  select r, string_split_regex(replace(text, chr(13), ''), '{licences.SENTENCE_END}') as x from d where regexp_matches(text, '{licences.LICENCE_LIKE}')),
s as (
  select r, i, sentence from (select r, generate_subscripts(x, 1) as i, unnest(x) as sentence from parts)
  where regexp_matches(sentence, '{licences.LICENCE_LIKE}')),
w as materialized (select r, i, sentence, {_sql_sentence_id("sentence")} as id from s),
l as materialized (
  select *, sum(case when id is null then 0 else 1 end) over (partition by r, i order by j rows unbounded preceding) as block
  from (select r, i, j, line, {_sql_sentence_id("line")} as id
        from (select r, i, generate_subscripts(x, 1) as j, unnest(x) as line from (select r, i, string_split(sentence, chr(10)) as x from w where id is null)))),
runs as (
  select r, i, j, {_sql_sentence_id("line")} as id
  from (select r, i, min(j) as j, string_agg(line, ' ' order by j) as line from l where id is null group by r, i, block)),
found as materialized (
  select r, i, 0 as j, id from w where id is not null
  union all select r, i, j, id from l where id is not null
  union all select r, i, j, id from runs where id is not null),
ids as (
  select * from found
  union all select r, i, 0, '{licences.UNKNOWN}' from w where not exists (select 1 from found f where f.r = w.r and f.i = w.i)),
m0 as (select r, string_agg('<' || id || '>', '' order by i, j) as s, cast([] as varchar[]) as found from ids group by r),
{_sql_rules()},
named as (select r, string_agg(id, '>' order by i, j) as names, count(*) as n from ids group by r)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_sentences, coalesce(names, '') as sentence_ids,
       coalesce(array_to_string(found, ','), '') as licences,
       cast(coalesce(len(regexp_extract_all(s, '<[^=>]*>')), 0) as bigint) as n_unmatched
from d left join named on d.r = named.r left join m{len(licences.RULES)} m on d.r = m.r
"""


@register("op1_licence_sentences", OP1_SQL)
def op1_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their licence sentences, in order, and the licences that the rules make of them."""
    found = licences.scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ">").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"), F.size("unmatched").cast("long").alias("n_unmatched"))


def _sql_html_lines(html: str) -> str:
    """DuckDB text of `line_dedup.html_lines`."""
    text = f"regexp_replace({html}, '{line_dedup.NO_TEXT}', chr(10), 'g')"
    text = f"regexp_replace({text}, '{line_dedup.LINE_TAGS}', chr(10), 'g')"
    text = f"regexp_replace({text}, '{line_dedup.ANY_TAG}', '', 'g')"
    for entity, char in line_dedup.ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity, char.replace("'", "''"))
    return f"list_filter(list_transform(string_split_regex({text}, '[\r\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '')"


OP2_SQL = f"""
with p as materialized (
  select row_number() over () as r, page_id,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
         {_sql_html_lines("html")} as lines
  from pages),
shown as (select distinct r, host, unnest(lines) as line from p),
common as (
  select s.host, s.line from shown s join (select host, count(*) as n from p group by host) t
    on s.host is not distinct from t.host
  where t.n >= 10 group by s.host, s.line, t.n having count(*) * 10 > t.n),
exploded as (select r, host, unnest(lines) as line, generate_subscripts(lines, 1) as i from p),
kept as (
  select e.r, string_agg(e.line, chr(10) order by e.i) as text, count(*) as n
  from exploded e anti join common c on e.host is not distinct from c.host and e.line = c.line group by e.r)
select page_id, host, cast(coalesce(len(lines), 0) as bigint) as n_lines,
       cast(coalesce(len(lines), 0) - coalesce(kept.n, 0) as bigint) as n_dropped, coalesce(kept.text, '') as text
from p left join kept on p.r = kept.r
"""


@register("op2_site_line_dedup", OP2_SQL)
def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without the lines that stand on over a tenth of their host's pages (hosts of ten pages or more)."""
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", line_dedup.url_host(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("lines"))
    clean = line_dedup.drop_boilerplate(stage(pages, "lines"), "host", "lines", ["page_id"], max_ratio=0.1, min_pages=10)
    return clean.select("page_id", "host", "n_lines", "n_dropped", F.array_join("kept_lines", "\n").alias("text"))


#: Crawl date of the stored pages, which carry none.
CRAWL_DATE = "2024-01-01T00:00:00Z"


@register("op3_warc_derivatives")
def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page's response record."""
    responses = warc.responses_from_pages(read_table(spark, sf_dir, "pages"), CRAWL_DATE)
    return warc.derive(responses, source_col="page_id").withColumnRenamed("source", "page_id")


@register("op4_jump_shards")
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by jump consistent hashing of doc_id, with the move to 17 shards.

    The slots follow a digest order inside the shard. A null text has size 1 and the checksum of no bytes.
    """
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(docs, ["doc_id"], 16)
    slotted = sharding.number_slots(placed, ["doc_id", "text_crc32", "size"], 16)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")




#: The key of the registered query; a production key comes from the caller's secret store.
PSEUDONYM_KEY = "registered-query-key"


@register("op5_feistel_pseudonyms")
def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the personal data in their texts replaced, and the pseudonyms in text order."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = pii.pseudonymise(docs, "text", PSEUDONYM_KEY)
    return clean.select("doc_id", F.col("clean_text").alias("text"), F.size("replaced").cast("long").alias("n_replaced"), "replaced")


@register("op6_suffix_tree_repeats")
def op6_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that also start in a smaller doc_id."""
    kept = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP7_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
i as (select coalesce(cast(item_id as varchar), '') as item_id, {_SQL_WORDS} as w from benchmark),
iw as materialized (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
sizes as (select distinct n from iw),
starts as (select r, n, w, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n),
spans as materialized (
  select r, k, s.n, win from (select r, n, k, array_to_string(w[k:k + n - 1], ' ') as win from starts) s
  where win in (select win from iw)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from spans) group by r),
named as (
  select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids
  from (select distinct r, win from spans) join iw using (win) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join named using (r)
"""


@register("op7_benchmark_contamination", OP7_SQL)
def op7_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, in windows of 10 item words."""
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, the same on the driver and the executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces of at most 2048, in as few sequences as the packing finds."""
    docs = read_table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, vocabulary_path(), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op9_robust_outliers")
def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base counts, and the verdict of the robust distance in their language and source."""
    found = quality.assess(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


@register("op10_lsh_forest_components")
def op10_lsh_forest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate component: 5-word shingles, similarity 0.85 or more."""
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85, shingle=5)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP11_SQL = r"""
with t as materialized (
  select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         coalesce(doc_id, 9223372036854775807) as id
  from documents),
w as (select r, doc_id, part, text, id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
f as materialized (
  select doc_id, part,
         (case when len(ws) < 50 then 'A' else '' end) ||
         (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end) ||
         (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end) ||
         (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) ||
         (case when id > min(id) over (partition by text) then 'E' else '' end) as fails
  from w),
known as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad
  from labels group by doc_id),
patterns as materialized (
  select part, fails, count(*) as n, sum(coalesce(good, 0)) as n_good, sum(coalesce(bad, 0)) as n_bad
  from f left join known on f.doc_id = known.doc_id group by part, fails),
letters as (select * from (values ('A'), ('B'), ('C'), ('D'), ('E')) as x(f)),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where b.f <> a.f and c.f not in (a.f, b.f) and d.f not in (a.f, b.f, c.f) and e.f not in (a.f, b.f, c.f, d.f)),
steps as materialized (
  select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as earlier
  from orders, (select * from (values (1), (2), (3), (4), (5)) as x(step)) as s),
met as (
  select part, filter_order, step, own, fails, n, n_good, n_bad, contains(fails, own) as hit,
         length(translate(earlier, fails, '')) = length(earlier) as reached
  from patterns, steps),
counted as (
  select part, filter_order, step, own,
         sum(case when reached and not hit then n else 0 end) as kept, sum(case when reached and hit then n else 0 end) as removed,
         sum(case when hit and not reached then n else 0 end) as redundant, sum(case when fails = own then n else 0 end) as unique_fails,
         sum(case when reached and hit then n_good else 0 end) as good_lost, sum(case when reached and hit then n_bad else 0 end) as toxic_lost
  from met group by part, filter_order, step, own)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from counted
"""


@register("op11_filter_interactions", OP11_SQL)
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through five filters in all 120 orders, counted for each source."""
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _sql_codebooks(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The plain iteration, one step after the other: x holds a row for each component, cN a row for each entry's."""
    steps = []
    for k in range(1, rounds + 2):
        steps.append(f"""
d{k} as materialized (
  select x.vec_id, x.p, c.e, cast(sum((x.x - c.c) * (x.x - c.c)) as bigint) as d
  from x join c{k - 1} c on x.p = c.p and x.q = c.q group by x.vec_id, x.p, c.e),
a{k} as materialized (select vec_id, p, cast(min(d * {entries} + e) % {entries} as bigint) as e, min(d) as d from d{k} group by vec_id, p)""")
        if k <= rounds:
            steps.append(f"""
m{k} as (
  select a.p, a.e, x.q, sum(x.x) as s, count(*) as n from a{k} a join x on a.vec_id = x.vec_id and a.p = x.p group by a.p, a.e, x.q),
c{k} as materialized (
  select c.p, c.e, c.q, coalesce(cast(floor(cast(m.s as double) / m.n) as bigint), c.c) as c
  from c{k - 1} c left join m{k} m on c.p = m.p and c.e = m.e and c.q = m.q)""")
    return f"""
with kept as materialized (
  select vec_id, label, embedding as v, row_number() over (order by vec_id) as rk, len(embedding) // {parts} as w
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0),
places as (select vec_id, rk, v, w, unnest(range(1, len(v) + 1)) as i from kept),
x as materialized (
  select vec_id, rk, (i - 1) // w as p, (i - 1) % w as q, cast(floor({scale} * cast(v[i] as double)) as bigint) as x from places),
c0 as materialized (select p, rk - 1 as e, q, x as c from x where rk <= {entries}),
{",".join(steps)},
coded as (
  select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds + 1} group by vec_id),
books as (select sha256(string_agg(cast(c as varchar), ',' order by p, e, q)) as codebooks_sha256 from c{rounds})
select coded.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept on coded.vec_id = kept.vec_id, books
"""


OP12_SQL = _sql_codebooks()


@register("op12_dual_tree_codes", OP12_SQL)
def op12_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of 8 parts with 16 entries each, after 6 rounds."""
    coded, codebooks = vector_codes.compress_vectors(read_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    summed = vector_codes.label_errors(stage(coded, "codes"))
    return summed.select("vec_id", vector_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error",
                         F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


@register("op13_forced_boundary_bpe")
def op13_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, and decoded again."""
    return bpe_codec.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
