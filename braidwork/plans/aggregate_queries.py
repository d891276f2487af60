"""Distributions, calibration, reports, paired statistics and vector summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import columns as C
from braidwork.operators import joining, measuring, statistics
from braidwork.plans.catalog import query, rounded
from braidwork.plans.inputs import CLIPS, SCORES, clips, scores
from braidwork.session import table

K = f"with k as ({CLIPS})"
Q = ", ".join(f"round(coalesce(quantile_cont({{v}}::double, {q}), 0), 6) as p{int(q * 100):02d}" for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
DIST = "count({v}) as n, round(coalesce(avg({v}), 0), 6) as mean, round(coalesce(min({v}), 0), 6)::double as least, round(coalesce(max({v}), 0), 6)::double as most, " + Q


@query(f"select {DIST.format(v='l_extendedprice')} from lineitem")
def e01_e02_distribution(spark, sf):
    return rounded(measuring.described(table(spark, sf, "lineitem"), "l_extendedprice"))


@query(f"{K} select cmi_bin, {DIST.format(v='recall')} from k group by 1")
def e04_per_bin(spark, sf):
    return rounded(measuring.described(clips(spark, sf), "recall", "cmi_bin"))


GRID = ([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9], [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5])


@query(f"{K}, g as (select r::double as tau_recall, c::double as tau_cer from (select unnest({GRID[0]}) as r), (select unnest({GRID[1]}) as c)) select tau_recall, tau_cer, count(*) filter (where recall >= tau_recall and cer <= tau_cer) as kept, round(count(*) filter (where recall >= tau_recall and cer <= tau_cer) / count(*), 6) as rate from k, g group by 1, 2")
def e03_threshold_sweep(spark, sf):
    return rounded(measuring.swept(clips(spark, sf), *GRID))


@query(f"{K}, t as (select round(greatest(0.6, quantile_cont(recall, 0.1)), 3) as tau_recall, round(least(0.5, quantile_cont(cer, 0.9)), 3) as tau_cer from k where recall is not null and cer is not null) select tau_recall, tau_cer, count(*) as n, count(*) filter (where recall >= tau_recall and cer <= tau_cer) as kept from k, t where recall is not null and cer is not null group by 1, 2")
def e05_calibration(spark, sf):
    return measuring.calibrated(clips(spark, sf).where("recall is not null and cer is not null"))


@query(
    f"{K} select case when grouping(cmi_bin) = 0 then 'cmi_bin' when grouping(voice) = 0 then 'voice' else 'all' end as grouping, coalesce(cmi_bin, voice, '') as value, count(*) as n, round(avg(recall), 6) as recall, round(avg(cer), 6) as cer, round(avg(dur), 6) as dur, round(avg((recall >= 0.5 and cer <= 0.3)::int), 6) as passing from k group by grouping sets ((), (cmi_bin), (voice))"
)
def e11_g07_eval_report(spark, sf):
    ok = ((F.col("recall") >= 0.5) & (F.col("cer") <= 0.3)).cast("int")
    return rounded(measuring.grouped_report(clips(spark, sf), ["cmi_bin", "voice"], F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("cer").alias("cer"), F.avg("dur").alias("dur"), F.avg(ok).alias("passing")))


@query(f"{K} select case when grouping(voice) = 0 and grouping(cmi_bin) = 0 then 'cell' when grouping(voice) = 0 then 'voice' when grouping(cmi_bin) = 0 then 'bin' else 'speed' end as kind, voice, cmi_bin, speed, count(*) as n from k where is_synthetic group by grouping sets ((voice), (cmi_bin), (voice, cmi_bin), (speed))")
def e15_balance_tables(spark, sf):
    v, b = F.grouping("voice") == 0, F.grouping("cmi_bin") == 0
    kind = F.when(v & b, "cell").when(v, "voice").when(b, "bin").otherwise("speed")
    k = clips(spark, sf).where("is_synthetic")
    sets = [[F.col("voice")], [F.col("cmi_bin")], [F.col("voice"), F.col("cmi_bin")], [F.col("speed")]]
    return k.groupingSets(sets, F.col("voice"), F.col("cmi_bin"), F.col("speed")).agg(kind.alias("kind"), F.count("*").alias("n")).select("kind", "voice", "cmi_bin", "speed", "n")


@query(f"{K} select domain, round(avg(recall), 6) as recall, round(avg(recall) - case domain when 'en' then 0.9 when 'de' then 0.8 end, 6) as delta from k group by 1")
def e19_recall_by_mode(spark, sf):
    ref = spark.sql("select * from values ('en', 0.9d), ('de', 0.8d) as t(domain, ref)")
    m = clips(spark, sf).groupBy("domain").agg(F.avg("recall").alias("recall")).join(F.broadcast(ref), "domain", "left")
    return rounded(m.select("domain", "recall", (F.col("recall") - F.col("ref")).alias("delta")))


@query(f"{K} select voice, round(avg(mos), 6) as mean, round(min(mos), 6) as least, round(max(mos), 6) as most, count(cer) as n_scored from k group by 1")
def e20_e44_by_voice(spark, sf):
    return rounded(clips(spark, sf).groupBy("voice").agg(F.avg("mos").alias("mean"), F.min("mos").alias("least"), F.max("mos").alias("most"), F.count("cer").alias("n_scored")))


@query(f"{K} select domain, round(avg(recall) filter (where hyp is not null), 6) as accent, count(*) filter (where hyp is not null) as n from k group by 1")
def e12_e21_scorable_mean(spark, sf):
    return rounded(clips(spark, sf).groupBy("domain").agg(F.avg(F.when(F.col("hyp").isNotNull(), F.col("recall"))).alias("accent"), F.count("hyp").alias("n")))


@query("with c as (select c_nationkey as g, c_mktsegment as v, sum(cast(c_acctbal as bigint) % 7 + 1)::bigint as weight, min(c_custkey) as o from customer group by all), r as (select *, row_number() over (partition by g order by weight desc, o) as rn from c) select g as c_nationkey, v as c_mktsegment, weight from r where rn = 1".replace("cast(c_acctbal as bigint)", "cast(floor(abs(c_acctbal)) as bigint)"))
def e36_commonest_value(spark, sf):
    c = table(spark, sf, "customer")
    return measuring.commonest(c, ["c_nationkey"], "c_mktsegment", F.floor(F.abs("c_acctbal")) % 7 + 1, F.col("c_custkey"))


@query("select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1 having count(*) >= 2")
def e37_support(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


@query("select l_returnflag, round(quantile_cont(l_quantity / (l_tax + 1), 0.5), 6) as median_rtf, round(avg(l_quantity), 6) as mean_s, round(avg((l_quantity >= 45 or l_discount > 0.08)::int), 6) as tail from lineitem group by 1")
def e39_e41_j12_panel(spark, sf):
    li = table(spark, sf, "lineitem")
    tail = ((F.col("l_quantity") >= 45) | (F.col("l_discount") > 0.08)).cast("int")
    return rounded(li.groupBy("l_returnflag").agg(F.percentile(F.col("l_quantity") / (F.col("l_tax") + 1), 0.5).alias("median_rtf"), F.avg("l_quantity").alias("mean_s"), F.avg(tail).alias("tail")))


@query("with d as (select unnest(range(1, 65)) as i, embedding as e from embeddings), m as (select i - 1 as dim, avg(abs(e[i]::double)) as l1 from d group by 1), r as (select *, row_number() over (order by l1 desc, dim) as rank from m) select dim, round(l1, 6) as l1, rank from r where rank <= 16")
def e42_g05_dimension_means(spark, sf):
    return rounded(measuring.dimension_means(table(spark, sf, "embeddings"), "embedding", 16))


@query("with s as (select event_type, list_sort(list(value)) as v, avg(value) as mean, stddev_pop(value) as sd, min(value) as least from events group by 1) select event_type, round(mean, 6) as mean, round(sd, 6) as sd, round(least, 6) as least, round(v[len(v) // 2 + 1], 6) as upper_median from s")
def e43_bench_stats(spark, sf):
    e = table(spark, sf, "events").where("value is not null").groupBy("event_type")
    # the upper median is a discrete percentile taken from above
    out = e.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), (-F.expr("percentile_disc(0.5) within group (order by -value)")).alias("upper_median"))
    return rounded(out)


PAIRS = f"with s as ({SCORES}), p as (select axis, utt_id, max(case when system = 'cand' then value end) - max(case when system = 'ref' then value end) as delta from s where value is not null group by all)"


@query(f"{PAIRS}, m as (select axis, count(delta) as n, avg(delta) as mean, stddev_samp(delta) as sd from p where delta is not null group by 1) select axis, n, round((mean + 0.05) / (sd / sqrt(n)), 4) as z from m")
def e27_noninferiority_z(spark, sf):
    m = joining.paired(scores(spark, sf), "ref", "cand").groupBy("axis").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"))
    return rounded(m.select("axis", "n", ((F.col("mean") + 0.05) / (F.col("sd") / F.sqrt("n"))).alias("z")), 4)


@query("with a as (select event_type as axis, (count(*) % 37) / 370.0 as p from events group by 1), r as (select axis, p, row_number() over (order by p, axis) as rank, count(*) over () as k from a), t as (select *, 0.05 / (k - rank + 1) as threshold from r) select axis, round(p, 6)::double as p, rank, round(threshold, 6)::double as threshold, min((p <= threshold)::int) over (order by rank) = 1 as rejected from t")
def e28_holm(spark, sf):
    a = table(spark, sf, "events").groupBy(F.col("event_type").alias("axis")).agg((F.count("*") % 37 / 370.0).alias("p"))
    return rounded(measuring.holm(a, 0.05))


@query()
def e25_e26_certification(spark, sf):
    p = joining.paired(scores(spark, sf), "ref", "cand")
    return rounded(statistics.certified(p, {"O": 0.05, "F": 0.05}))


@query()
def e31_intervals(spark, sf):
    return rounded(statistics.intervals(joining.paired(scores(spark, sf), "ref", "cand")))


@query("with a as (select vec_id, embedding::double[] as e from embeddings) select a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) as cosine, round(list_max(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))), 6) as gap, round(10 * log10(list_dot_product(a.e, a.e) / list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) ** 2))), 6) as snr from a join a b on b.vec_id = a.vec_id + 1")
def j03_j04_vector_gaps(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return rounded(e.join(b, "vec_id").select("vec_id", C.cosine(x, y).alias("cosine"), C.max_difference(x, y).alias("gap"), C.snr_db(x, y).alias("snr")))


@query("with a as (select vec_id, list_transform(range(1, 65), lambda i: case when (i - 1) in (0, 5, 9) then case when embedding[i] > 0 then embedding[i]::double / 1.5 else embedding[i]::double * 1.5 end else embedding[i]::double end) as l from embeddings) select vec_id, list_position(l, list_max(l)) - 1 as best from a")
def j10_penalised_arg_max(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"))
    return e.select("vec_id", C.arg_max(C.repeat_penalty(F.col("l"), F.array(F.lit(0), F.lit(5), F.lit(9)), 1.5)).alias("best"))


@query("select c_custkey, round(2 * a * b / (a + b), 6) as hm from (select c_custkey, greatest(c_acctbal / 10000, 1e-6) as a, greatest((c_custkey % 100) / 100, 1e-6) as b from customer)")
def j01_harmonic_mean(spark, sf):
    return rounded(table(spark, sf, "customer").select("c_custkey", C.harmonic_mean(F.col("c_acctbal") / 10000, F.col("c_custkey") % 100 / 100).alias("hm")))


@query(f"{K} select count(*) as n, count(distinct text) as n_texts, count(distinct voice) as n_voices, count(*) filter (where cmi_bin = 'high') as n_high, round(avg(recall), 6) as recall, round(sum(dur) / 3600, 6) as hours from k")
def e09_corpus_report(spark, sf):
    return rounded(clips(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"), F.count_distinct("voice").alias("n_voices"), F.count_if(F.col("cmi_bin") == "high").alias("n_high"), F.avg("recall").alias("recall"), (F.sum("dur") / 3600).alias("hours")))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def x01_event_windows(spark, sf):
    """Spark-native extra: event-time windows."""
    from braidwork.streaming.incremental import windowed_counts

    w = windowed_counts(table(spark, sf, "events"), "1 hour", "10 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select n_name, count(*) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate >= timestamp '1995-01-01' group by 1")
def x02_revenue_by_nation(spark, sf):
    """Spark-native extra: a star join with pushed filters and pruned columns."""
    li, o, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o.where("o_orderdate >= timestamp_ntz'1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(j.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")), 2)


@query("with a as (select event_type as axis, (count(*) % 37) / 370.0 as p from events group by 1), t as (select axis, p, row_number() over (order by p, axis) as rank, 0.1 * row_number() over (order by p, axis) / count(*) over () as threshold from a) select axis, round(p, 6)::double as p, rank, round(threshold, 6)::double as threshold, rank <= coalesce((select max(rank) from t where p <= threshold), 0) as flagged from t")
def e45_false_discoveries(spark, sf):
    a = table(spark, sf, "events").groupBy(F.col("event_type").alias("axis")).agg((F.count("*") % 37 / 370.0).alias("p"))
    return rounded(measuring.benjamini_hochberg(a, 0.10))


@query("with p as (select l_returnflag, l_orderkey, count(*) as n, sum(l_quantity) as s, sum(l_quantity * l_quantity) as q from lineitem group by all), t as (select l_returnflag, count(*) as a, sum(n) as m, sum(n * n) as n2, sum(s) as st, sum(q) as qt, sum(s * s / n) as b from p group by 1), v as (select *, (qt - b) / (m - a) as w from t), u as (select l_returnflag, w, greatest(0, ((b - st * st / m) / (a - 1) - w) / ((m - n2 / m) / (a - 1))) as bt from v) select l_returnflag, round(bt, 6)::double as \"between\", round(w, 6)::double as within, round(bt / (bt + w), 6)::double as icc from u")
def e45_variance_parts(spark, sf):
    return rounded(measuring.variance_parts(table(spark, sf, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity"))
