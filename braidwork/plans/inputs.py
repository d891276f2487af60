"""Views of the test tables in the shape of the engine's inputs, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = """
select doc_id, text, lang, source from documents union all
select * from (values (900001, 'ये coaching center है', 'hi', 'fix'), (900002, 'मैं late। camera, 2 b-ok', 'hi', 'fix'), (900003, 'only english here', 'en', 'fix'),
  (900004, 'यह पूरा हिन्दी वाक्य है', 'hi', 'fix'), (900005, '12 34 !!', 'xx', 'fix'), (900006, 'main मैं going घर to आज the बाज़ार', 'hi', 'fix')) t(doc_id, text, lang, source)"""
CLIPS = """
select doc_id as ord, 'c' || cast(doc_id % 300 as string) as corpus_id,
  'c' || cast(doc_id % 300 as string) || '__' || source || '__v' || cast(doc_id % 2 as string) as utt_id, source as voice, lang as domain, text,
  case when doc_id % 4 = 0 then 'none' when doc_id % 4 = 1 then 'low' when doc_id % 4 = 2 then 'med' else 'high' end as cmi_bin,
  case when doc_id % 17 = 0 then null else cast((n_chars * 7) % 100 as double) / 100 end as recall,
  case when doc_id % 19 = 0 then null else cast((n_chars * 3) % 60 as double) / 100 end as cer,
  case when doc_id % 23 = 0 then null else cast(n_chars % 400 as double) / 10 end as dur,
  case when doc_id % 29 = 0 then 16000 else 24000 end as sr,
  case when doc_id % 31 = 0 then ' ' when doc_id % 37 = 0 then null else 'x' || source end as hyp,
  cast((n_chars * 11) % 500 as double) / 100 as mos, cast(doc_id % 3 + 1 as double) / 2 as speed,
  case when doc_id % 41 = 0 then 'too_short' when doc_id % 43 = 0 then 'recall_low' else null end as reason,
  doc_id % 5 <> 0 as is_synthetic
from documents"""
CANDIDATES = """
select 'u' || cast(l_orderkey as string) as utt_id, l_linenumber as cand_id,
  case when l_partkey % 9 = 0 then null else cast(l_partkey % 11 as double) / 10 end as en_recall, l_quantity / 25 as nll, 2.5 + l_discount * 10.0007 as utmos,
  case when l_suppkey % 13 = 0 then null else 0.6 + l_tax * 1.00011 end as secs, cast(l_partkey % 50 as double) / 10 * 1.00013 as f0_std, cast(l_suppkey % 40 as double) * 1.00017 as energy_dr,
  l_quantity / 5 as dur, cast(l_partkey % 100 as double) / 180 as silence_ratio, cast(l_suppkey % 10 as double) / 28 as ngram_rep, l_returnflag as voice
from lineitem"""
SCORES = """
select case when l_linenumber % 2 = 1 then 'ref' else 'cand' end as system, l_linestatus as axis,
  'u' || cast(l_orderkey as string) || '_' || cast(floor((l_linenumber + 1) / 2) as string) as utt_id,
  case when l_linenumber % 2 = 0 then l_quantity / 50 + 0.01 when l_partkey % 20 = 0 then null else l_quantity / 50 end as value from lineitem"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The result of a query over the named tables."""
    text = sql
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TEXTS, "documents")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLIPS, "documents")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CANDIDATES, "lineitem")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORES, "lineitem")
