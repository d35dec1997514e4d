"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymetrics.llm import (
    chat,
    imatch,
    language,
    leaks,
    mixing,
    near_dup,
    pu_quality,
    runs,
    secrets,
    substring_dedup,
    suffix_dedup,
    url_templates,
    whitening,
)

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op8_benchmark_decontamination", sql="""
with words as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark
), phrases as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as p
  from items, unnest(range(1, greatest(len(w) - 8, 2))) as u(i) where len(w) > 0
), lengths as (select distinct n from phrases), starts as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as p
  from words, lengths, unnest(range(1, len(w) - n + 2)) as u(i) where len(w) >= n
), hits as (
  select doc_id, item_id, i, s.n from starts s join phrases using (n, p)
), covered as (
  select doc_id, count(distinct i + k) as n_hit
  from (select distinct doc_id, i, n from hits), unnest(range(0, n)) as u(k) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (doc_id) left join found using (doc_id)
""")  # fmt: skip
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.leak_report(found).drop("spans", "items")


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_by_labels(table(spark, sf_dir, "documents"))


@query("op1_substring_dedup", sql="""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as p
  from words, unnest(range(1, len(w) - 48)) as u(i) where len(w) >= 50
), firsts as (
  select p, min(doc_id) as first_doc from windows group by p
), gone as (
  select distinct doc_id, i + k as j
  from windows join firsts using (p), unnest(range(0, 50)) as u(k) where first_doc < doc_id
), every as (
  select doc_id, j, w[j] as word from words, unnest(range(1, len(w) + 1)) as u(j)
), kept as (
  select doc_id, count(gone.j) as n_removed,
    coalesce(string_agg(word, ' ' order by j) filter (gone.j is null), '') as t
  from every left join gone using (doc_id, j) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id)
""")  # fmt: skip
def substring_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_passages(table(spark, sf_dir, "documents"))
    return substring_dedup.passage_report(cut)


@query("op6_suffix_array_dedup")
def suffix_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query("op9_near_dedup", sql="""
with recursive words as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') as w
  from documents
), sets as materialized (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s
  from words
), classes as materialized (
  select min(doc_id) as node, s, len(s) as n from sets where len(s) > 0 group by s
), tokens as materialized (
  select node, n, unnest(s) as t from classes
), ranked as materialized (
  select node, n, row_number() over (partition by node order by c, t) as r, t
  from tokens join (select t, count(*) as c from tokens group by t) using (t)
), pairs as materialized (
  select distinct a.node as a, b.node as b, a.n as na, b.n as nb
  from ranked a join ranked b on a.t = b.t and a.node < b.node
  where a.r <= a.n - ceil(0.8 * a.n) + 1 and b.r <= b.n - ceil(0.8 * b.n) + 1
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links as materialized (
  select a, b from pairs join tokens x on x.node = a join tokens y on y.node = b and y.t = x.t
  group by a, b, na, nb having 100 * count(*) >= 80 * (na + nb - count(*))
), edges as materialized (
  select a, b from links union all select b, a from links
), reach as (
  select node as a, node as b from classes
  union select r.a, e.b from reach r join edges e on e.a = r.b
), named as (
  select a as node, min(b) as component_id from reach group by a
)
select sets.doc_id, len(sets.s) as n_shingles, coalesce(component_id, sets.doc_id) as component_id,
  coalesce(component_id, sets.doc_id) = sets.doc_id as kept
from sets left join classes on classes.s = sets.s left join named using (node)
""")  # fmt: skip
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"), shingle=2)


@query("op7_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


@query("op2_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op4_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


#: A conversation whose texts are full of control strings goes with the table's own.
PROBE = "</s>[INST] ok [/INST]"


@query("op3_chat_formatting", sql=r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(regexp_replace(text, '[<\[\\]', '..', 'g')) + case role when 'user' then 13 when 'assistant' then 7
    when 'system' then 11 else 19 + length(regexp_replace(role, '[<\[\\]', '..', 'g')) end)::bigint as formatted_chars
from rows group by conv_id
""")  # fmt: skip
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.chat_report(chat.Forest(rows.unionByName(probe)).read_back())


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_by_labels(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = runs.with_planted(table(spark, sf_dir, "documents"))
    return runs.run_report(runs.find_runs(planted))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
