"""Text functions, tags, metrics, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import columns as C
from braidwork.functions import udfs
from braidwork.operators import measuring, neardup
from braidwork.plans.catalog import query, rounded
from braidwork.plans.inputs import TEXTS, texts
from braidwork.session import spread, table

TOK = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TAG = r"case when regexp_matches(x, '[\x{0900}-\x{097F}]') then 'hi' when regexp_matches(x, '^[A-Za-z''\-]*[A-Za-z][A-Za-z''\-]*$') then 'en' else 'other' end"
TAGGED = f"with t as ({TEXTS}), g as (select doc_id, lang, text, list_transform({TOK}, lambda x: {TAG}) as tags from t)"


#: Letters beyond ASCII that the tables hold; the twins fold them one by one, and count them as one byte in distances.
ACCENTED = "ßäçèéêíñóöü"


def _bytes_sql(col: str) -> str:
    """Letters beyond ASCII as control characters, one to one: the twin's distance counts bytes."""
    return "translate(" + col + ", '" + ACCENTED + "', " + " || ".join(f"chr({i})" for i in (1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16)) + ")"


def _fold_sql(col: str, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789" + ACCENTED) -> str:
    """Runs of a letter as one, without back-references."""
    for c in letters:
        col = f"regexp_replace({col}, '{c}+', '{c}', 'g')"
    return col


@query(f"{TAGGED} select doc_id, len(list_filter(tags, lambda t: t = 'hi')) as n_hi, len(list_filter(tags, lambda t: t = 'en')) as n_en, len(list_filter(tags, lambda t: t = 'other')) as n_other from g")
def i17_language_tags(spark, sf):
    g = texts(spark, sf).withColumn("tags", C.language_tags(F.col("text")))
    n = lambda t: F.size(F.filter("tags", lambda x: x == t)).cast("long").alias(f"n_{t}")
    return g.select("doc_id", n("hi"), n("en"), n("other"))


SEQ = f"{TAGGED}, s as (select doc_id, lang, list_filter(tags, lambda t: t <> 'other') as q from g), m as (select *, len(q) as n, len(list_filter(range(1, len(q)), lambda i: q[i] <> q[i + 1])) as sw, len(list_filter(q, lambda t: t = 'en')) as en from s), r as (select doc_id, lang, sw, case when n < 2 then 0.0 else sw / (n - 1) end as density, case when n = 0 then 0.0 else least(en, n - en) / n end as cmi from m)"
BIN = "case when cmi = 0 then 'none' when cmi <= 0.2 then 'low' when cmi <= 0.4 then 'med' else 'high' end"


@query(f"{SEQ} select doc_id, round(density::double, 6) as density, round(cmi::double, 6) as cmi, {BIN} as cmi_bin from r")
def i18_switch_density(spark, sf):
    g = texts(spark, sf).withColumn("tags", C.language_tags(F.col("text")))
    out = g.select("doc_id", C.switch_density(F.col("tags")).alias("density"), C.mixing_index(F.col("tags")).alias("cmi"))
    return rounded(out.withColumn("cmi_bin", C.mixing_bin(F.col("cmi"))))


@query(f"{SEQ} select lang, {BIN} as cmi_bin, count(*) as n, round(avg(density)::double, 6) as density, round(avg(sw)::double, 6) as switches from r group by all")
def tag_summary(spark, sf):
    g = spread(texts(spark, sf), table(spark, sf, "documents")).select("lang", C.language_string(F.col("text")).alias("letters"))
    switches, density, index = C.mixing(F.col("letters"))
    g = g.select("lang", C.mixing_bin(index).alias("cmi_bin"), density.alias("d"), switches.alias("s"))
    return rounded(g.groupBy("lang", "cmi_bin").agg(F.count("*").alias("n"), F.avg("d").alias("density"), F.avg("s").alias("switches")))


@query(f"{SEQ} select round(avg(sw)::double, 6) as switches from r")
def e08_switch_points(spark, sf):
    letters = texts(spark, sf).select(C.language_string(F.col("text")).alias("letters"))
    return rounded(letters.agg(F.avg(C.mixing(F.col("letters"))[0]).alias("switches")))


STOP_HI = ("hai", "main", "the", "of")
HINDI_ROMAN = ("and", "thing", "inge")


@query(
    f"with t as ({TEXTS}) select doc_id, len(list_filter({TOK}, lambda x: {TAG} = 'hi' or ({TAG} = 'en' and regexp_replace(lower(x), '^[''\\-]+|[''\\-]+$', '', 'g') in {STOP_HI + HINDI_ROMAN}))) as n_hi from t"
)
def i27_lexicon_tags(spark, sf):
    lists = [F.array(*map(F.lit, x)) for x in (HINDI_ROMAN, STOP_HI)]
    tags = F.transform(C.tokens(F.col("text")), lambda t: C.lexicon_tag(t, *lists))
    return texts(spark, sf).select("doc_id", F.size(F.filter(tags, lambda t: t == "hi")).cast("long").alias("n_hi"))


@query(rf"select doc_id, array_to_string(list_transform({TOK}, lambda w: case when length(w) > 2 and w like '%a' and length(regexp_replace(w, '[^aeiou]', '', 'g')) >= 2 then left(w, length(w) - 1) else w end), ' ') as folded from documents")
def i03_final_schwa(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.drop_final_schwa(F.col("text")).alias("folded"))


@query(f"select c_custkey, {_fold_sql("translate(lower(c_name), 'w', 'v')")} as folded from customer")
def i04_fold_variants(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.fold_variants(F.lower("c_name")).alias("folded"))


def _phonetic_sql(col: str) -> str:
    soft = f"regexp_replace(translate(lower({col}), 'w', 'v'), 'c([eiy])', 's\\1', 'g')"
    hard = f"replace(replace(replace(replace(replace({soft}, 'ch', '~'), 'c', 'k'), 'q', 'k'), 'x', 'ks'), '~', 'ch')"
    return _fold_sql(f"replace(replace({hard}, 'ph', 'f'), 'z', 'j')")


WORDS = f"with t as (select distinct lower(unnest({TOK})) as w from documents), a as (select w from t where regexp_matches(w, '^\\p{{L}}+$'))"


def _words(spark, sf):
    return table(spark, sf, "documents").select(F.explode(C.tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("w")).distinct().where(F.col("w").rlike(r"^\p{L}+$"))


@query(f"{WORDS} select w, {_phonetic_sql('w')} as phonetic, regexp_replace({_phonetic_sql('w')}, '[aeiou]+', '', 'g') as skeleton from a")
def i08_i09_phonetic_forms(spark, sf):
    return _words(spark, sf).select("w", C.phonetic(F.col("w")).alias("phonetic"), C.skeleton(F.col("w")).alias("skeleton"))


class _Close:
    """1 minus the edit distance over the longer length, in characters."""

    def format(self, a: str, b: str) -> str:
        return f"1 - levenshtein({_bytes_sql(a)}, {_bytes_sql(b)}) / greatest(length({a}), length({b}), 1)"


CLOSE = _Close()


@query(
    f"{WORDS}, p as (select w, reverse(w) as r, substr(w, 2) as v, {_phonetic_sql('w')} as pw, {_phonetic_sql('substr(w, 2)')} as pv from a), s as (select *, regexp_replace(pw, '[aeiou]+', '', 'g') as sw, regexp_replace(pv, '[aeiou]+', '', 'g') as sv from p)"
    f" select w, round(({CLOSE.format(a='w', b='r')})::double, 6) as closeness, w = v or {CLOSE.format(a='w', b='v')} >= 0.8 or {CLOSE.format(a='pw', b='pv')} >= 0.8 or (length(sw) >= 2 and length(sv) >= 2 and {CLOSE.format(a='sw', b='sv')} >= 0.8) as same from s"
)
def i07_i10_word_match(spark, sf):
    w = F.col("w")
    v = F.expr("substr(w, 2)")
    return rounded(_words(spark, sf).select("w", C.closeness(w, F.reverse(w)).alias("closeness"), C.same_word(w, v).alias("same")))


@query(f"{WORDS} select w, regexp_matches(w, '[fqxz]|(tion|ing|ment|able|ness|ful|phone|app)$') as looks, regexp_matches(w, 'tion|ing|ment|ous|que|wh|ck$|ed$|ly$') or (regexp_matches(w, '[qwxf]') and length(w) > 6) as spells from a")
def i13_i36_looks_english(spark, sf):
    return _words(spark, sf).select("w", C.looks_english(F.col("w")).alias("looks"), C.spells_english(F.col("w")).alias("spells"))


STOP = "a an the to of in on at is are am be been being and or but so if it i you we he she they my your his her our their this that these those for with as it's i'm".split()
ENG = "list_transform(list_filter({t}, lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z''\\-]*$') and not list_contains([" + ", ".join("'" + s.replace("'", "''") + "'" for s in STOP) + "], lower(x))), lambda x: regexp_replace(lower(x), '^[''\\-]+|[''\\-]+$', '', 'g'))"
ENG_DOC = ENG.format(t=TOK)


@query(f"select doc_id, len({ENG_DOC}) as n, md5(array_to_string({ENG_DOC}, ' ')) as words from documents")
def i29_english_words(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", C.english_words(F.col("text"), STOP).alias("e"))
    return d.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join("e", " ").cast("binary")).alias("words"))


PAIRED = f"with d as (select doc_id, {ENG_DOC} as e from documents), p as (select a.doc_id, a.e as x, list_distinct(b.e) as y from d a join d b on b.doc_id = a.doc_id + 1), k as (select doc_id, x, list_filter(list_distinct(x), lambda w: len(list_filter(y, lambda h: h = w or (abs(length(h) - length(w)) <= 2 and levenshtein(w, h) <= greatest(1, length(w) // 4)))) > 0) as known from p)"


def _paired(spark, sf):
    """(doc_id, x, y): a text and the next one's."""
    docs = table(spark, sf, "documents")
    y = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y"))
    return docs.select("doc_id", F.col("text").alias("x")).join(y, "doc_id").transform(spread, docs)


@query(f"{PAIRED} select doc_id, round(case when len(x) = 0 then null else len(list_filter(x, lambda w: list_contains(known, w))) / len(x) end, 6) as recall from k")
def i30_i31_english_recall(spark, sf):
    return rounded(_paired(spark, sf).select("doc_id", udfs.english_recall(STOP)("x", "y").alias("recall")))


GRAM = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {m}), '|'))"


@query(f"with d as (select doc_id, {TOK} as w from documents), g as (select doc_id, len(w) as n, {GRAM.format(n=4, m=3)} as g from d) select doc_id, round(case when n < 4 then 0 else (len(g) - len(list_distinct(g))) / len(g) end::double, 6) as repetition from g")
def i19_ngram_repetition(spark, sf):
    return rounded(table(spark, sf, "documents").select("doc_id", C.tokens(F.col("text")).alias("w")).select("doc_id", C.ngram_repetition(F.col("w"), 4).alias("repetition")))


@query(f"with d as (select doc_id, {TOK} as w from documents), g as (select doc_id, unnest({GRAM.format(n=3, m=2)}) as g from d where len(w) >= 4), c as (select doc_id, g, count(*) as c from g group by all), s as (select doc_id, max(c) / sum(c) as s from c group by all) select d.doc_id, round(coalesce(s, 0)::double, 6) as share from d left join s using (doc_id)")
def i20_top_ngram_share(spark, sf):
    return rounded(spread(table(spark, sf, "documents")).select("doc_id", C.tokens(F.col("text")).alias("w")).select("doc_id", C.top_ngram_share(F.col("w")).alias("share")))


@query(f"with d as (select doc_id, list_transform({TOK}, lambda x: lower(x)) as w from documents), u as (select doc_id, unnest(w) as x from d), c as (select doc_id, max(c) as top from (select doc_id, x, count(*) as c from u group by all) group by all) select d.doc_id, case when len(w) < 5 then 'too_short' when top >= greatest(4, len(w) // 2) then 'token_repetition' else '' end as reason from d left join c using (doc_id)")
def c07_degenerate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.degenerate(F.col("text")).alias("reason"))


@query("with s as (select conv_id, turn, replace(text, ' ', '') as s from conversations) select conv_id, turn, case when length(s) = 0 then 0 when length(s) < 5 then 1 else len(list_distinct(list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5)))) end as n from s")
def i21_char_shingles(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(C.shingles(F.col("text"))).cast("long").alias("n"))


@query(f"select doc_id, 'c' || left(sha1(array_to_string({TOK}, ' ')), 8) as corpus_id, 'c' || left(sha1(array_to_string({TOK}, ' ')), 8) || '__maya__sp' || cast(10 + doc_id % 5 as string) || '__t' || case when doc_id % 2 = 0 then 'x' else 'hot' end || '__v0' as utt_id from documents")
def i23_identity(spark, sf):
    cid = C.corpus_id(F.col("text"))
    tier = F.when(F.col("doc_id") % 2 == 1, "hot")
    speed = (F.col("doc_id") % 5 + 10) / 10
    return table(spark, sf, "documents").select("doc_id", cid.alias("corpus_id"), C.clip_id(cid, F.lit("maya"), speed, tier, F.lit(0)).alias("utt_id"))


_SPELLED = "lower(replace(text, '\"', ''))"
for _mark, _word in (("&", " और "), ("@", " ऐट दी रेट "), ("%", " प्रतिशत "), ("#", " हैश "), ("$", " डॉलर "), ("£", " पाउंड "), ("°", " डिग्री ")):
    _SPELLED = f"replace({_SPELLED}, '{_mark}', '{_word}')"


@query(f"select doc_id, trim(regexp_replace({_SPELLED}, '\\s+', ' ', 'g')) as speech from documents")
def i38_speech_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.speech_text(F.col("text")).alias("speech"))


def _numbers_sql(col: str) -> str:
    """Runs of digits from 0 to 10 spelled; twice, as neighbours share what stands between them."""
    for n, word in enumerate(["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"] * 2):
        col = f"regexp_replace({col}, '(^|[^0-9]){n % 11}($|[^0-9])', '\\1{word}\\2', 'g')"
    return col


COMPARE = f"with d as (select doc_id, lang, {TOK} as w from documents), c as (select doc_id, lang, lower(array_to_string(list_transform(w, lambda w: case when length(w) > 2 and w like '%a' and length(regexp_replace(w, '[^aeiou]', '', 'g')) >= 2 then left(w, length(w) - 1) else w end), ' ')) as s from d), n as (select doc_id, lang, unnest(list_filter(string_split_regex(regexp_replace({_numbers_sql('strip_accents(s)')}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) as w from c), f as (select doc_id, lang, {_fold_sql("translate(w, 'w', 'v')", 'abcdefghijklmnopqrstuvwxyzß_0123456789')} as w from n)"


def _compared(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", "lang", F.explode(F.split(udfs.compare_space("text"), " ")).alias("w")).where("w <> ''")


@query(f"{COMPARE}, k as (select lang, w, count(*) as c from f group by all) select lang, sum(c)::bigint as n_tokens, count(*) as n_types, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) as entropy from k group by lang")
def e06_token_entropy(spark, sf):
    d = _compared(spark, sf).withColumn("ws", F.array("w"))
    return rounded(measuring.entropy(d, F.col("ws"), "lang"))


ENTROPY = "select log2(sum(c)) - sum(c * log2(c)) / sum(c) as entropy from (select w, count(*) as c from (select unnest({tok}) as w from {t}) group by all)"


@query(f"with a as ({ENTROPY.format(tok=TOK, t='documents')}), b as ({ENTROPY.format(tok=TOK, t='benchmark')}) select round(a.entropy, 6) as entropy, round(b.entropy, 6) as real_entropy, round(a.entropy / b.entropy, 6) as ratio, a.entropy / b.entropy < 0.85 as alarm from a, b")
def e13_e16_erosion(spark, sf):
    one = lambda t: measuring.entropy(table(spark, sf, t), C.tokens(F.col("text")))
    return rounded(measuring.eroded(one("documents"), one("benchmark")))


@query(f"with u as (select unnest({TOK}) as w from documents) select round(count(distinct w) / count(*), 6) as ratio from u")
def e07_unique_word_ratio(spark, sf):
    e = measuring.entropy(table(spark, sf, "documents"), C.tokens(F.col("text")))
    return rounded(e.select((F.col("n_types") / F.col("n_tokens")).alias("ratio")))


@query("with r as (select conv_id, role, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as g from conversations), i as (select conv_id, role, g, count(*) as n from r group by all) select conv_id, max(n) as longest from i group by conv_id")
def f14_longest_run(spark, sf):
    return measuring.longest_runs(table(spark, sf, "conversations"), "conv_id", "turn", "role")


def _next_turns(spark, sf):
    """(conv_id, turn, a, b): a turn's text and the next one's; joined, so that no task sees a whole conversation."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"]).transform(spread, c)


@query(f"with c as (select conv_id, turn, lower(text) as t from conversations), p as (select a.conv_id, a.turn, a.t as a, b.t as b from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1) select conv_id, turn, round(({CLOSE.format(a='a', b='b')})::double, 6) as closeness from p")
def i14_turn_closeness(spark, sf):
    p = _next_turns(spark, sf)
    return rounded(p.select("conv_id", "turn", C.closeness(F.lower("a"), F.lower("b")).alias("closeness")))


@query("select conv_id, turn, 1.0::double as recall, 0.0::double as cer, 0.0::double as wer, 1.0::double as similarity from conversations where length(trim(text)) > 0")
def i11_self_hypothesis(spark, sf):
    t = table(spark, sf, "conversations").where("length(trim(text)) > 0")
    return t.select("conv_id", "turn", udfs.recall("text", "text").alias("recall"), udfs.cer("text", "text").alias("cer"), udfs.wer("text", "text").alias("wer"), udfs.similarity("text", "text").alias("similarity"))


@query()
def b03_pair_scores(spark, sf):
    return rounded(_next_turns(spark, sf).select("conv_id", "turn", udfs.pair_scores("a", "b").alias("s")).select("conv_id", "turn", "s.*"), 4)


@query()
def i32_clause_chunks(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(udfs.clauses("text")).alias("pos", "chunk"))


@query()
def i33_sentences(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(udfs.sentences("text")).alias("pos", "sentence"))


@query()
def i34_token_chunks(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(udfs.token_chunks(40)("text")).alias("pos", "chunk"))


@query()
def i01_romanise(spark, sf):
    return spread(texts(spark, sf)).select("doc_id", udfs.romanise("text").alias("latin"), udfs.compare_space("text").alias("compared"))


@query()
def i37_mixed_normaliser(spark, sf):
    norm = udfs.mixed_normaliser({"hai": "है", "mera": "मेरा"}, {"delhi": "दिल्ली"}, {"main": "मैं", "the": "थे", "to": "तो"}, {"only", "english", "here", "going", "and", "of"}, {"naam": "नाम"})
    return spread(texts(spark, sf)).select("doc_id", norm("text").alias("n")).select("doc_id", "n.out", F.size("n.spans").alias("n_spans"))


@query()
def c04_c06_clean_gate(spark, sf):
    t = spread(texts(spark, sf))
    return t.select("doc_id", udfs.clean("text").alias("clean"), udfs.repair("text").alias("repaired")).select("doc_id", F.col("clean").isNotNull().alias("passes"), F.length("repaired").alias("n_repaired"))


SIG = "list_transform(range(0, 16), lambda p: coalesce(list_min(list_transform(g, lambda x: left(md5(cast(p as string) || ':' || x), 16))), ''))"


@query(
    f"""with recursive d as (select doc_id, {TOK} as w from documents), g as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), chr(31)))) as g from d),
    s as (select doc_id, {SIG} as s from g), o as (select min(doc_id) as doc_id, s from s group by s),
    e as (select a.doc_id as a, b.doc_id as b from o a join o b on a.doc_id < b.doc_id where len(list_filter(range(1, 17), lambda i: a.s[i] = b.s[i])) >= 0.85 * 16),
    r as (select 0 as k, doc_id as i, []::bigint[] as kept from (select min(doc_id) - 1 as doc_id from o) union all
      select k + 1, n.doc_id, case when exists (select 1 from e where e.b = n.doc_id and list_contains(r.kept, e.a)) then r.kept else list_append(r.kept, n.doc_id) end
      from r join (select doc_id, row_number() over (order by doc_id) as rn from o) n on n.rn = r.k + 1)
    select unnest(kept) as doc_id from (select kept from r order by k desc limit 1)"""
)
def d11_near_duplicates(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    signed = neardup.word_signed(d.select("doc_id", C.tokens(F.col("text")).alias("w")), F.col("w"), 16).select("doc_id", "sig")
    return neardup.kept(signed, "doc_id", 0.85).select("doc_id")
