"""Sources, gates, joins, set operations and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import columns as C
from braidwork.operators import joining, measuring
from braidwork.operators.ranking import first_wins, running
from braidwork.plans.catalog import query, rounded
from braidwork.plans.inputs import CLIPS, SCORES, clips, scores
from braidwork.sources import manifest
from braidwork.session import table
from braidwork.streaming import incremental

K = f"with k as ({CLIPS})"
GATE = "case when trim(hyp) = '' then 'asr_empty' when sr <> 24000 then 'sr_bad' when dur < 3 then 'too_short' when dur > 30 then 'too_long' when recall < 0.8 then 'recall_low' when cer > 0.3 then 'cer_high' when mos < 1.5 then 'dnsmos_low' end"


def _gate():
    c = F.col
    return C.accept_reason(c("hyp"), c("sr"), c("dur"), c("recall"), c("cer"), c("mos"), least_mos=1.5)


@query(f"{K} select ord, {GATE} as reason, {GATE} is null as accept from k")
def c01_accept_gate(spark, sf):
    return clips(spark, sf).select("ord", _gate().alias("reason")).withColumn("accept", F.col("reason").isNull())


CLOSED = f"case when recall is null then 'asr_missing' when reason is not null then reason when dur is null then 'sr_bad' else {GATE} end"


@query(f"{K} select coalesce({CLOSED}, 'accepted') as reason, count(*) as n from k group by 1")
def c02_e17_fail_closed(spark, sf):
    closed = F.when(F.col("recall").isNull(), "asr_missing").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("dur").isNull(), "sr_bad").otherwise(_gate())
    return clips(spark, sf).groupBy(F.coalesce(closed, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


TAU = "values ('none', 0.85, 0.12), ('low', 0.83, 0.14), ('med', 0.76, 0.20), ('high', 0.70, 0.25)"


@query(
    f"{K}, t(b, r, c) as ({TAU}), g as (select k.*, case when reason in ('too_short', 'too_long', 'asr_missing') or recall is null then coalesce(reason, 'asr_missing') when recall < r then 'recall_low' when cer > c then 'cer_high' end as new from k left join t on b = cmi_bin)"
    " select cmi_bin, count(*) as total, count(*) filter (where new is null) as accepted, count(*) filter (where new is null and reason is not null) as recovered from g group by 1"
)
def c03_e35_bin_aware_gate(spark, sf):
    new = C.regated_reason(F.col("cmi_bin"), F.col("reason"), F.col("recall"), F.col("cer"))
    g = clips(spark, sf).withColumn("new", new)
    return g.groupBy("cmi_bin").agg(F.count("*").alias("total"), F.count_if(F.col("new").isNull()).alias("accepted"), F.count_if(F.col("new").isNull() & F.col("reason").isNotNull()).alias("recovered"))


@query(f"{K} select ord from k where cmi_bin = 'high' or mos >= 4.5")
def c09_hard_slice(spark, sf):
    return clips(spark, sf).where("cmi_bin = 'high' or mos >= 4.5").select("ord")


@query(f"{K} select coalesce(case when trim(coalesce(hyp, '')) = '' then 'no_text' when dur is null or dur < 1 or dur > 30 then 'dur' when doc = 0 then 'missing_wav' end, 'usable') as reason, count(*) as n from (select *, ord % 10 as doc from k) group by 1")
def c10_usable_rows(spark, sf):
    bad = F.when(F.coalesce(F.trim("hyp"), F.lit("")) == "", "no_text").when(F.col("dur").isNull() | (F.col("dur") < 1) | (F.col("dur") > 30), "dur").when(F.col("ord") % 10 == 0, "missing_wav")
    return clips(spark, sf).groupBy(F.coalesce(bad, F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query("select doc_id from documents where not regexp_matches(text, '[0-9]') and n_chars between 80 and 900")
def c12_c13_digit_free_range(spark, sf):
    return table(spark, sf, "documents").where(~F.col("text").rlike(r"\d") & F.col("n_chars").between(80, 900)).select("doc_id")


@query("select doc_id from documents d where trim(text) not in (select trim(text) from benchmark) and trim(text) not in (select trim(text) from conversations where text is not null)")
def c14_leak_exclusion(spark, sf):
    return joining.without_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), table(spark, sf, "conversations")).select("doc_id")


@query("select i as doc_id from (select doc_id as i, len(list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z''\\-]*$'))) as n from documents) where n >= 40")
def c16_c17_english_bearing(spark, sf):
    return table(spark, sf, "documents").where(F.size(C.english_words(F.col("text"), [])) >= 40).select("doc_id")


@query(f"{K}, c as (select domain || cast(ord % 50 as string) as key, ord, nullif(hyp, ' ') as hyp, cmi_bin from k), r as (select key, min_by(struct_pack(h := hyp, b := cmi_bin), ord) as r from c where ord % 3 = 0 group by key), f as (select key, r.h, r.b from r), l as (select key, ord, case when ord % 7 = 0 then '' when ord % 11 = 0 then null else hyp end as hyp, case when ord % 5 = 0 then null else cmi_bin end as cmi_bin from c) select l.ord, coalesce(nullif(l.hyp, ''), f.h) as hyp, coalesce(nullif(l.cmi_bin, ''), f.b) as cmi_bin from l left join f using (key)")
def d01_enrich_first_wins(spark, sf):
    c = clips(spark, sf).select(F.concat("domain", (F.col("ord") % 50).cast("string")).alias("key"), "ord", F.nullif("hyp", F.lit(" ")).alias("hyp"), "cmi_bin")
    left = c.withColumn("hyp", F.when(F.col("ord") % 7 == 0, "").when(F.col("ord") % 11 != 0, F.col("hyp"))).withColumn("cmi_bin", F.when(F.col("ord") % 5 != 0, F.col("cmi_bin")))
    return joining.enriched(left, c.where("ord % 3 = 0"), "key", "ord", ["hyp", "cmi_bin"]).select("ord", "hyp", "cmi_bin")


LAST = "select utt_id, max_by(ord, ord) as ord, arg_max(coalesce(recall, -1), ord) as recall from k group by utt_id"


@query(f"{K} {LAST}")
def d02_f13_last_wins(spark, sf):
    c = clips(spark, sf).select("utt_id", "ord", F.coalesce("recall", F.lit(-1.0)).alias("recall"))
    return first_wins(c, ["utt_id"], "ord", last=True)


@query(f"{K} select utt_id, case when b is null then 'left' when a is null then 'right' else 'both' end as side from (select utt_id, max(case when ord % 3 <> 0 then ord end) as a, max(case when ord % 4 <> 0 then ord end) as b from k group by utt_id having a is not null or b is not null)")
def d03_h02_key_sets(spark, sf):
    c = clips(spark, sf)
    return joining.compared(c.where("ord % 3 <> 0"), c.where("ord % 4 <> 0"), "utt_id", "ord")


@query(f"{K}, l as (select corpus_id, arg_max(voice, ord) as v, arg_max(domain, ord) as d from k where ord % 300 < 150 group by 1) select ord, coalesce(v, voice) as voice, coalesce(d, domain) as domain from k left join l using (corpus_id)")
def d04_lookup_or_self(spark, sf):
    c = clips(spark, sf)
    return joining.with_fallback(c.select("ord", "corpus_id", "voice", "domain"), c.where("ord % 300 < 150"), "corpus_id", "ord", ["voice", "domain"]).select("ord", "voice", "domain")


@query(f"{K}, c as (select corpus_id, min_by(cmi_bin, ord) as b from k where ord % 2 = 0 group by 1) select coalesce(b, '?') as cmi_bin, count(*) as n from k left join c on split_part(utt_id, '__', 1) = c.corpus_id group by 1")
def d05_derived_key(spark, sf):
    c = clips(spark, sf)
    bins = first_wins(c.where("ord % 2 = 0").select("corpus_id", "ord", "cmi_bin"), ["corpus_id"], "ord").select("corpus_id", F.col("cmi_bin").alias("b"))
    keyed = c.select(F.substring_index("utt_id", "__", 1).alias("corpus_id"))
    return keyed.join(bins, "corpus_id", "left").groupBy(F.coalesce("b", F.lit("?")).alias("cmi_bin")).agg(F.count("*").alias("n"))


PAIRS = f"with s as ({SCORES}), p as (select axis, utt_id, max(case when system = 'ref' then value end) as ref, max(case when system = 'cand' then value end) as cand from s where value is not null group by all having ref is not null and cand is not null)"


@query(f"{PAIRS} select axis, count(*) as n, round(avg(ref), 6) as ref, round(avg(cand), 6) as cand, round(avg(cand - ref), 6) as delta, round(stddev_samp(cand - ref), 6) as sd from p group by axis")
def d06_e22_paired_axes(spark, sf):
    p = joining.paired(scores(spark, sf), "ref", "cand")
    return rounded(p.groupBy("axis").agg(F.count("*").alias("n"), F.avg("ref").alias("ref"), F.avg("cand").alias("cand"), F.avg("delta").alias("delta"), F.stddev_samp("delta").alias("sd")))


@query("select d.doc_id, l.quality, l.doc_id is null as missing from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)".replace("l.doc_id is null", "l.quality is null"))
def d07_missing_hypotheses(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").withColumn("missing", F.col("quality").isNull())


@query(f"{K} select utt_id, min(ord) as ord from k where utt_id not in (select utt_id from k where ord % 3 = 0) group by 1 order by 2 limit 100")
def d08_g02_resume(spark, sf):
    c = clips(spark, sf)
    plan = c.groupBy("utt_id").agg(F.min("ord").alias("ord"))
    return incremental.resume(plan, c.where("ord % 3 = 0"), "utt_id", "ord", 100)


@query("select doc_id from documents where doc_id in (select doc_id from labels where quality = 0)")
def d09_semi_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")


@query("with p as (select p_partkey, p_name, [p_type, p_brand] as chunks from part) select v.v as voice, s.s as speed, count(*) as clips, sum(len(chunks))::bigint as chunks, sum(length(chunks[1]) + length(chunks[2]))::bigint as chars from p, (values ('maya'), ('arjun')) v(v), (values (0.9::double), (1.0), (1.1)) s(s), (values (null), ('hot')) t(t) where length(trim(p_name)) > 0 group by all")
def d10_e18_plan_expansion(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"), F.array("p_type", "p_brand").alias("chunks"))
    plan = joining.expanded(p, ["maya", "arjun"], [0.9, 1.0, 1.1], [None, "none", "hot"])
    size = F.aggregate(F.transform("chunks", F.length), F.lit(0), lambda s, x: s + x)
    return plan.groupBy("voice", "speed").agg(F.count("*").alias("clips"), F.sum(F.size("chunks")).alias("chunks"), F.sum(size).alias("chars"))


@query(f"{K}, a as (select cmi_bin, avg(recall) as a from k where ord % 2 = 0 and cmi_bin <> 'med' group by 1), b as (select cmi_bin, avg(recall) as b from k where ord % 2 = 1 or cmi_bin = 'med' group by 1) select coalesce(a.cmi_bin, b.cmi_bin) as cmi_bin, round(a, 6) as a, round(b, 6) as b, round(b - a, 6) as delta from a full join b on a.cmi_bin = b.cmi_bin")
def d17_e14_bin_deltas(spark, sf):
    c = clips(spark, sf)
    mean = lambda where: c.where(where).groupBy("cmi_bin").agg(F.avg("recall").alias("m"))
    return rounded(measuring.bin_deltas(mean("ord % 2 = 0 and cmi_bin <> 'med'"), mean("ord % 2 = 1 or cmi_bin = 'med'"), "cmi_bin", "m"))


@query(f"{PAIRS} select axis, round(avg((abs(cand - ref) <= 0.05 * ref)::int), 6) as agreement from p group by axis")
def d15_j11_ratio_agreement(spark, sf):
    p = joining.paired(scores(spark, sf), "ref", "cand")
    return rounded(p.groupBy("axis").agg(F.avg((F.abs("delta") <= 0.05 * F.col("ref")).cast("int")).alias("agreement")))


@query(f"{PAIRS} select axis, round(quantile_cont(ref, 0.5), 6) as ref, round(quantile_cont(cand, 0.5), 6) as cand, quantile_cont(cand, 0.5) / quantile_cont(ref, 0.5) - 1 < -0.25 as alarm from p group by axis")
def d16_e34_c18_flattening(spark, sf):
    p = joining.paired(scores(spark, sf), "ref", "cand").groupBy("axis").agg(F.percentile("ref", 0.5).alias("ref"), F.percentile("cand", 0.5).alias("cand"))
    return rounded(p.withColumn("alarm", F.col("cand") / F.col("ref") - 1 < -0.25))


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then lang end, case when doc_id % 2 = 0 then source end, 'none') as hyp from documents")
def a05_first_alias(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("none")).alias("hyp"))


@query("select min(doc_id) as first_id, source, arg_min(lang, doc_id) as lang from documents group by source")
def a26_first_per_voice(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("first_id"), "lang", "doc_id")
    return first_wins(d, ["source"], "doc_id").select("first_id", "source", "lang")


@query("select doc_id, sha256(text) as sha256 from documents")
def a22_checksum(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("select vec_id, list_slice(embedding, 9, 16) as part from embeddings")
def a20_buffer_slice(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 9, 8).alias("part"))


@query("select text, 'documents' as origin, source as domain from documents where length(trim(text)) > 0 union all select text, 'benchmark', null from benchmark union all (select text, 'conversations', role from conversations)")
def a07_a24_h01_union(spark, sf):
    a = table(spark, sf, "documents").where("length(trim(text)) > 0").select("text", F.lit("documents").alias("origin"), F.col("source").alias("domain"))
    b = table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("origin"))
    c = table(spark, sf, "conversations").select("text", F.lit("conversations").alias("origin"), F.col("role").alias("domain"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c)


@query("select i as id, replace(['say {w} now', 'no {w}', '{w} again'][i % 3 + 1], '{w}', ['one', 'two'][(i // 3) % 2 + 1]) as text from range(12) t(i)")
def a25_stub_transcripts(spark, sf):
    return manifest.stub_transcripts(spark, 12, ["say {w} now", "no {w}", "{w} again"], ["one", "two"])


@query("select c_custkey as ord, split_part(l, chr(9), 1) as deva, split_part(l, chr(9), 2) as roman, coalesce(try_cast(split_part(l, chr(9), 3) as bigint), 1) as n from (select c_custkey, c_mktsegment || chr(9) || c_name || chr(9) || case when c_custkey % 3 = 0 then 'x' else cast(c_custkey as string) end as l from customer)")
def a14_lexicon(spark, sf):
    line = F.concat_ws("\t", "c_mktsegment", "c_name", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_custkey").cast("string")))
    return manifest.lexicon_rows(table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.split(line, "\t").alias("p")))


@query(f"{K} select ord, concat_ws('; ', case when v is null then 'utt_id is null' end, case when hyp is null then 'ref_orig is null' end, case when ver <> 'corpus_manifest_v1' then 'schema_version is unknown' end, case when b not in ('none', 'low', 'med', 'high') then 'cmi_bin is unknown' end) as problems from (select ord, hyp, case when ord % 50 = 0 then null else utt_id end as v, case when ord % 60 = 0 then 'v0' else 'corpus_manifest_v1' end as ver, case when ord % 70 = 0 then 'odd' else cmi_bin end as b from k)")
def b02_validation(spark, sf):
    c = clips(spark, sf)
    r = c.select("ord", F.when(F.col("ord") % 50 != 0, F.col("utt_id")).alias("utt_id"), F.col("hyp").alias("ref_orig"), F.when(F.col("ord") % 60 == 0, "v0").otherwise(manifest.VERSION).alias("schema_version"), F.when(F.col("ord") % 70 == 0, "odd").otherwise(F.col("cmi_bin")).alias("cmi_bin"), "is_synthetic", F.array(F.lit("hi")).alias("lang_tags"))
    return r.select("ord", F.array_join(manifest.problems(), "; ").alias("problems"))


@query(f"{K} select ord, coalesce(hyp, text) as hyp, case when hyp is null then null else {GATE} is null end as accept, case when hyp is null then 'needs_asr' else {GATE} end as reason from k")
def b05_decision_row(spark, sf):
    missing = F.col("hyp").isNull()
    reason = F.when(missing, "needs_asr").otherwise(_gate())
    return clips(spark, sf).select("ord", F.coalesce("hyp", "text").alias("hyp"), F.when(~missing, reason.isNull()).alias("accept"), reason.alias("reason"))


@query("select doc_id, substr(list_filter(f, lambda x: x like 'domain:%')[1], 8) as domain from (select doc_id, case when doc_id % 4 = 0 then ['speed:1'] else ['q:1', 'domain:' || lang] end as f from documents)")
def b07_flag_value(spark, sf):
    f = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("speed:1"))).otherwise(F.array(F.lit("q:1"), F.concat(F.lit("domain:"), "lang")))
    d = table(spark, sf, "documents").select("doc_id", f.alias("f"))
    return d.select("doc_id", F.substring_index(F.get(F.filter("f", lambda x: x.startswith("domain:")), F.lit(0)), ":", -1).alias("domain"))


@query("select doc_id, case when doc_id % 6 >= 4 then 'high' when doc_id % 6 >= 2 then 'med' else 'low' end as bucket, ['maya', 'arjun', 'asha', 'dev'][(row_number() over (order by doc_id) - 1) % 4 + 1] as voice from documents")
def b11_b12_rotation(spark, sf):
    d = running(table(spark, sf, "documents").select("doc_id"), [], ["doc_id"], "n")
    voice = F.get(F.array(*map(F.lit, ("maya", "arjun", "asha", "dev"))), (F.col("n") % 4).cast("int"))
    return d.select("doc_id", C.english_bucket(F.col("doc_id") % 6).alias("bucket"), voice.alias("voice"))


@query("select distinct word from (select unnest(string_split(lower(p_name), ' ')) as word from part) where word not in (select lower(c_mktsegment) from customer) union select 'hai'")
def h03_h04_word_sets(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    held = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("word"))
    return words.join(held, "word", "left_anti").union(spark.sql("select 'hai' as word")).distinct()


@query("with f as (select user_id, min(ts) filter (where event_type = 'view') as a, min(ts) filter (where event_type = 'click') as b, min(ts) filter (where event_type = 'purchase') as c from events group by 1) select 0 as n, 'view' as step, count(a) as users, count(a) as reached from f union all select 1, 'click', count(b), count(*) filter (where a is not null and b >= a) from f union all select 2, 'purchase', count(c), count(*) filter (where a is not null and b >= a and c >= b) from f")
def a21_event_funnel(spark, sf):
    return incremental.funnel(table(spark, sf, "events"), ["view", "click", "purchase"])


@query("select distinct user_id from events where event_type = 'signup' and value > 90 and user_id not in (select user_id from events where event_type = 'purchase' and value > 90)")
def a21_wasted(spark, sf):
    e = table(spark, sf, "events").where("value > 90")
    return incremental.wasted(e, "signup", "purchase")
