"""Registered queries of this subpackage, each over its whole table, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.chat_format import parse_conversations

    return parse_conversations(_table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), every=50)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.secrets import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.language_model import train_and_score

    return train_and_score(_table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.pii import TEST_KEY, configured_key, digest, replace

    return digest(replace(_table(spark, sf_dir, "documents"), configured_key(spark, TEST_KEY)))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.ngram_jaccard import join_similar

    return join_similar(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.toxicity import train_and_score

    return train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.language_id import train_and_predict

    return train_and_predict(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorgrid.llm.sentencepiece import encode

    return encode(_table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
i as (
  select distinct item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where item_id is not null),
iw as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from i where len(w) > 0)),
dw as (
  select rid, p, n, array_to_string(w[p:p + n - 1], ' ') as win
  from (select rid, n, w, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from iw) where len(w) >= n)),
hits as (select rid, p, dw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win),
words as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from hits) group by rid),
items as (
  select rid, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct rid, cast(item_id as varchar) as s from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (rid) left join items using (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_neighbours": op1_neighbours, "op2_secrets": op2_secrets, "op3_language_model": op3_language_model, "op4_surrogates": op4_surrogates, "op5_ngram_jaccard": op5_ngram_jaccard, "op6_toxicity": op6_toxicity, "op7_language_id": op7_language_id, "op8_chat_format": op8_chat_format, "op9_decontaminate": op9_decontaminate, "op10_sentencepiece": op10_sentencepiece}


def oracle_sql() -> dict[str, str]:
    from sensorgrid.llm import neighbours, secrets

    return {"op1_neighbours": neighbours.oracle(), "op2_secrets": secrets.oracle(), "op9_decontaminate": OP9_SQL}
