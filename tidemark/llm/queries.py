"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import covertree, decontam, langid, mixing, ngramjoin, secrets, sharding, substring, urlrules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op6_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_url_rules, op4_mix_sources, op5_warc_derivatives, op6_embedding_near_dups, op7_language_id, op8_shard_documents, op9_secret_scan, op10_ngram_jaccard)}

MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(md5(cast(doc_id as varchar)), md5('null:' || coalesce(text, ''))) k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size
  from {docs}),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint w from s),
u as (select *,
        coalesce(sum(source_size) over r, 0) full_size,
        sum(w) over () - coalesce(sum(w) over r, 0) open_w,
        sum(source_size) over () all_size
      from w window r as (order by source_size / w, source nulls first rows between unbounded preceding and 1 preceding)),
f as (select *, 3 * all_size - 4 * full_size open_q, w * (3 * all_size - 4 * full_size) > 4 * source_size * open_w is_full from u),
l as (select open_q q, open_w ow from f where not is_full order by source_size / w, source nulls first limit 1),
t as (select source, source_size,
        coalesce(case when is_full then 2.0::double * source_size
             else (w * q)::double / (2.0::double * ow::double) end, 0.0::double) target
      from f left join l on true),
p as (select doc_id, size, source_size, target,
        coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) before_words
      from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end epochs from p)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before_words)))::bigint taken
from e
"""

SUBSTRING_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 11)) i from d),
t as (select doc_id, i, array_to_string(w[i:i + 12], ' ') x from s),
m as (select x, min(doc_id) lo from t group by x),
r as (select distinct t.doc_id, t.i + o.o j from t join m using (x), (select unnest(range(0, 13)) o) o where t.doc_id > m.lo),
k as (select doc_id, unnest(w) word, generate_subscripts(w, 1) j from d),
f as (select k.doc_id, count(r.j) n_removed, string_agg(case when r.j is null then k.word end, ' ' order by k.j) kept
      from k left join r on k.doc_id = r.doc_id and k.j = r.j group by k.doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join f using (doc_id)
"""

EMBEDDING_SQL = r"""
with recursive v as (select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
p as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id n, vec_id c from embeddings union select r.n, p.y from r join p on r.c = p.x),
m as (select n, min(c) c from r group by n),
k as (select x, count(*) k from p group by x)
select e.vec_id, coalesce(k.k, 0)::bigint n_links, m.c component_id, e.vec_id = m.c kept
from embeddings e left join k on e.vec_id = k.x left join m on e.vec_id = m.n
"""

ORACLE_SQL = {"op6_embedding_near_dups": EMBEDDING_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op4_mix_sources": MIX_SQL.format(docs="documents")}
