"""Quotas, trims, samples, splits, rewards and winners."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import choosing
from braidwork.operators.ranking import balanced, dealt, fill_quotas, first_wins, quotas, round_robin, split_exact, split_groups, stride, trimmed
from braidwork.plans.catalog import query, rounded
from braidwork.plans.inputs import CANDIDATES, CLIPS, candidates, clips
from braidwork.session import table

K = f"with k as ({CLIPS})"
HARD = f"(select * replace (case when cmi_bin = 'high' and ord % 3 <> 0 then 'none' else cmi_bin end as cmi_bin) from ({CLIPS}))"
QUOTA = f"""with b(cmi_bin, ord) as (values ('none', 0), ('low', 1), ('med', 2), ('high', 3)),
c as (select b.cmi_bin, b.ord, count(k.ord) as n from b left join {HARD} k on k.cmi_bin = b.cmi_bin group by 1, 2),
h as (select greatest(round_even(700 * 0.2, 0), round_even(700 * (select n from c where cmi_bin = 'high') / sum(n), 0))::bigint as hq, sum(n) filter (where cmi_bin <> 'high') as rest from c),
q as (select c.*, case when cmi_bin = 'high' then hq else round_even((700 - hq) * n / rest, 0)::bigint end as quota from c, h),
f as (select cmi_bin, ord, n, case when row_number() over (order by cmi_bin = 'high', quota desc, ord) = 1 then quota + 700 - sum(quota) over () else quota end::bigint as quota from q)"""


def _uneven(spark, sf):
    """All clips, two thirds of the high ones counted as none, so that quotas and supply differ."""
    return clips(spark, sf).withColumn("cmi_bin", F.expr("case when cmi_bin = 'high' and ord % 3 <> 0 then 'none' else cmi_bin end"))


@query(f"{QUOTA} select cmi_bin, n, quota from f")
def e10_quotas(spark, sf):
    return quotas(_uneven(spark, sf).groupBy("cmi_bin").agg(F.count("*").alias("n")), 700, 0.2).select("cmi_bin", "n", "quota")


TAKE = f"{QUOTA}, s as (select *, sum(greatest(quota - n, 0)) over () as short, greatest(n - quota, 0) as extra from f), e as (select *, coalesce(sum(extra) over (order by extra desc, ord rows between unbounded preceding and 1 preceding), 0) as before from s), t as (select cmi_bin, (least(n, quota) + greatest(0, least(extra, short - before)))::bigint as take from e)"


@query(f"{TAKE} select cmi_bin, take from t")
def f06_g08_backfill(spark, sf):
    return fill_quotas(quotas(_uneven(spark, sf).groupBy("cmi_bin").agg(F.count("*").alias("n")), 700, 0.2))


@query(f"{TAKE}, r as (select ord, cmi_bin, row_number() over (partition by cmi_bin order by ord) as rn from {HARD}) select r.ord from r join t using (cmi_bin) where rn <= take")
def f05_quota_selection(spark, sf):
    return balanced(_uneven(spark, sf), 700, 0.2, ["ord"]).select("ord")


CELLS = f"(select *, row_number() over (partition by voice, cmi_bin order by u) as rn from (select *, utt_id || cast(ord as string) as u from ({CLIPS})) )"


@query(
    f"with recursive c as (select voice, cmi_bin, count(*) as n, min(ord) as seen from ({CLIPS}) group by all), l as (select max(n) as lvl from c), lv as (select unnest(range(0, (select lvl + 1 from l))) as lvl), s as (select lvl, sum(least(n, lvl)) as tot from c, lv group by 1), p as (select min(lvl) as lvl from s where tot >= least(600, (select sum(n) from c))), e as (select lvl, (select tot from s where s.lvl = p.lvl) - 600 as over_ from p),"
    " k as (select c.*, lvl, over_, case when n >= lvl then row_number() over (order by n < lvl, seen) end as turn from c, e), cap as (select voice, cmi_bin, least(n, lvl) - case when n >= lvl and turn <= over_ then 1 else 0 end as cap from k)"
    f" select r.ord from {CELLS} r join cap using (voice, cmi_bin) where rn <= cap"
)
def f07_f08_balanced_trim(spark, sf):
    k = clips(spark, sf).withColumn("u", F.concat("utt_id", F.col("ord").cast("string")))
    return trimmed(k, 600, ["voice", "cmi_bin"], "u", "ord").select("ord")


@query(f"{K}, r as (select ord, voice, row_number() over (partition by voice order by ord) as n from k) select ord from r order by n, voice limit 130")
def f09_round_robin(spark, sf):
    return round_robin(clips(spark, sf).select("ord", "voice"), "voice", ["ord"], 130).select("ord")


@query("select corpus_id from (select corpus_id, row_number() over (order by corpus_id) - 1 as n from (select distinct 'c' || cast(o_custkey as string) as corpus_id from orders)) where n % 10 = 0 and n < 400")
def f10_stride_split(spark, sf):
    ids = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("corpus_id")).distinct()
    return stride(ids, ["corpus_id"], 10, 40)


@query("select l_orderkey, l_linenumber from (select *, row_number() over (order by l_orderkey, l_linenumber) as n from lineitem) where n % 7 = 0")
def f16_replay_sample(spark, sf):
    return stride(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 7, offset=6)


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def h08_exact_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(f"{K}, o as (select *, row_number() over (partition by corpus_id order by ord) as rn from k) select corpus_id, voice, ord from o where rn = 1")
def f17_first_seen(spark, sf):
    return first_wins(clips(spark, sf).select("corpus_id", "voice", "ord"), ["corpus_id"], "ord")


SIDE = "case when ('0x' || left(md5('7:' || corpus_id), 8))::bigint % 1000000 < 200000 then 'dev' else 'train' end"


@query(f"{K} select ord, corpus_id, {SIDE} as partition, count(distinct {SIDE}) over (partition by corpus_id) as sides from k")
def h05_h06_leak_free_split(spark, sf):
    s = split_groups(clips(spark, sf).select("ord", "corpus_id"), "corpus_id", 0.2)
    sides = s.groupBy("corpus_id").agg(F.count_distinct("partition").alias("sides"))
    return s.join(sides, "corpus_id").select("ord", "corpus_id", "partition", "sides")


@query()
def h05_exact_split(spark, sf):
    return split_exact(clips(spark, sf).select("corpus_id", "ord"), "corpus_id", 0.1, 7)


FL = f"""with c as ({CANDIDATES}), a as (select *, case when en_recall is null then 1.0 else 2 * greatest(en_recall, 1e-6) * greatest(exp(-nll / 3), 1e-6) / (greatest(en_recall, 1e-6) + greatest(exp(-nll / 3), 1e-6)) end as racc from c),
f as (select utt_id, quantile_cont(utmos, 0.5) - 0.10 as fu, coalesce(quantile_cont(secs, 0.5) - 0.02, 1.0) as fs, quantile_cont(f0_std, 0.25) * 0.95 as ff, quantile_cont(energy_dr, 0.25) * 0.95 as fe, quantile_cont(dur, 0.5) as fd, quantile_cont(racc, 0.5) as base from a group by 1)"""


@query(f"{FL} select utt_id, round(fu, 6) as floor_utmos, round(fs, 6) as floor_secs, round(ff, 6) as floor_f0_std, round(fe, 6) as floor_energy_dr, round(fd, 6) as floor_dur, round(base, 6) as base_racc from f")
def e32_group_floors(spark, sf):
    return rounded(choosing.floors(candidates(spark, sf)))


RW = f"""{FL}, r as (select a.*, f.base, silence_ratio > 0.45 or ngram_rep > 0.30 as bad, fu, fs, ff, fe, fd from a join f using (utt_id)),
s as (select *, round(racc, 4) as ra, not bad and utmos >= fu and (secs is null or secs >= fs - 0.03) and f0_std >= ff and energy_dr >= fe and abs(dur - fd) <= 0.15 * fd as ok,
round(racc - 0.3 * greatest(0, fu - utmos) - 0.5 * greatest(0, fs - 0.03 - coalesce(secs, 1.0)) - 0.1 * abs(dur - fd) / greatest(fd, 1e-6) - 0.2 * greatest(0, ff - f0_std) - 0.1 * greatest(0, fe - energy_dr) - case when bad then 5 else 0 end, 4) as tot from r)"""


def _rewarded(spark, sf):
    c = candidates(spark, sf)
    return choosing.rewarded(c.join(choosing.floors(c), "utt_id"))


@query(f"{RW} select utt_id, cand_id, ra as r_accent, bad as degenerate, ok as eligible, tot as total from s")
def j02_c11_reward(spark, sf):
    return rounded(_rewarded(spark, sf).select("utt_id", "cand_id", "r_accent", "degenerate", "eligible", "total"), 4)


@query(
    f"{RW}, w as (select utt_id, arg_max(struct_pack(c := cand_id, r := ra), struct_pack(o := ok::int, t := tot, i := -cand_id)) as w, arg_min(cand_id, struct_pack(r := ra, i := cand_id)) as l, max(ok::int) as any_, first(base) as base from s group by 1), g as (select *, round(w.r - base, 4) as gain from w), x as (select *, case when any_ = 0 then 'no_eligible' when gain < 0.02 then 'below_gain' else 'winner' end as status from g)"
    " select utt_id, status, case when status = 'winner' then w.c end as winner, case when status = 'winner' and l <> w.c then l end as loser, case when any_ = 1 then gain end as gain from x"
)
def f12_d14_winners(spark, sf):
    return rounded(choosing.winners(_rewarded(spark, sf), 0.02), 4)


@query(f"with c as ({CANDIDATES}), g as (select utt_id, avg(utmos) as m, max(utmos) as b from c group by 1) select round(avg(m), 6) as mean_of_means, round(avg(b), 6) as mean_of_best from g")
def e38_best_of_n(spark, sf):
    return rounded(choosing.best_of_n(candidates(spark, sf), "utt_id", "utmos"))


WON = f"{RW}, w as (select utt_id, arg_max(ra, struct_pack(o := ok::int, t := tot, i := -cand_id)) as r, max(ok::int) as any_, first(base) as base from s group by 1), x as (select utt_id, case when any_ = 1 then round(r - base, 4) end as gain, case when any_ = 0 then 'no_eligible' when round(r - base, 4) < 0.02 then 'below_gain' else 'winner' end as status from w)"


@query(f"{WON} select count(*) as n_prompts, count(*) filter (where status = 'winner') as n_winner, count(*) filter (where status = 'no_eligible') as n_no_eligible, count(*) filter (where status = 'below_gain') as n_below_gain, round(avg(gain), 4) as mean_gain from x")
def e33_winner_report(spark, sf):
    return rounded(choosing.winner_report(choosing.winners(_rewarded(spark, sf), 0.02)), 4)


@query(f"{WON}, o as (select utt_id, row_number() over (order by md5('11:' || utt_id), utt_id) as n from x where status <> 'winner'), k as (select count(*) filter (where status = 'winner') as n from x) select utt_id, 'winner' as origin from x where status = 'winner' union all select o.utt_id, 'replay' from o, k where o.n <= k.n // 2")
def h07_replay_mix(spark, sf):
    w = choosing.winners(_rewarded(spark, sf), 0.02).select("utt_id", "status")
    return choosing.with_replay(w.where("status = 'winner'").select("utt_id"), w.where("status <> 'winner'").select("utt_id"), "utt_id", 0.5, 11)


@query("with t as (select event_type, lower(event_type) as w, count(*) as n, min(event_id) as seen from events group by all) select event_type, n, row_number() over (order by n desc, seen) as rank from t")
def g04_most_common(spark, sf):
    from pyspark.sql import Window

    t = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return t.select("event_type", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "seen")).alias("rank"))


@query(f"{K}, f as (select utt_id, row_number() over (order by min(ord)) - 1 as n from k group by 1) select k.ord, (row_number() over (order by k.ord) - 1) % 3 as shard, f.n % 3 as group_shard from k join f using (utt_id)")
def f11_shards(spark, sf):
    rows = dealt(clips(spark, sf).select("ord", "utt_id"), ["ord"], 3)
    return dealt(rows.withColumnRenamed("shard", "s"), ["ord"], 3, "utt_id").select("ord", F.col("s").alias("shard"), F.col("shard").alias("group_shard"))
