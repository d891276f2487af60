"""Text, array and number functions as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVA = "[\\u0900-\\u097F\\uA8E0-\\uA8FF]"
LATIN_WORD = r"^['\-]*[A-Za-z][A-Za-z'\-]*$"


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once; expressions with lambdas aren't recognised as common otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[\x09-\x0D\x1C-\x20\x85   -     　]+"), lambda t: t != "")


def language_tag(token: Column) -> Column:
    """hi, en or other, by script."""
    return F.when(token.rlike(DEVA), "hi").when(token.rlike(LATIN_WORD), "en").otherwise("other")


def language_tags(text: Column) -> Column:
    return F.transform(tokens(text), language_tag)


def lexicon_tag(token: Column, hindi_roman: Column, stop: Column) -> Column:
    """Like language_tag, but a Latin word of the Hindi lists is hi."""
    word = F.regexp_replace(F.lower(token), r"^['\-]+|['\-]+$", "")
    latin = token.rlike(r"^[A-Za-z'\-]+$")
    return F.when(token.rlike(DEVA), "hi").when(latin & (F.array_contains(stop, word) | F.array_contains(hindi_roman, word)), "hi").when(latin, "en").otherwise("other")


def _languages(tags: Column) -> Column:
    return F.filter(tags, lambda t: t.isin("hi", "en"))


def _switches(seq: Column) -> Column:
    moves = F.zip_with(F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0))), F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    return F.aggregate(moves, F.lit(0), lambda s, x: s + x)


def switch_points(tags: Column) -> Column:
    return _switches(_languages(tags))


def switch_density(tags: Column) -> Column:
    """Share of neighbouring hi/en tokens that differ."""
    seq = _languages(tags)
    return F.when(F.size(seq) < 2, F.lit(0.0)).otherwise(_switches(seq) / F.greatest(F.size(seq) - 1, F.lit(1)))


def mixing_index(tags: Column) -> Column:
    """Share of the rarer language among hi/en tokens."""
    seq = _languages(tags)
    n, en = F.size(seq), F.size(F.filter(tags, lambda t: t == "en"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(en, n - en) / F.greatest(n, F.lit(1)))


def mixing_bin(index: Column) -> Column:
    return F.when(index == 0, "none").when(index <= 0.2, "low").when(index <= 0.4, "med").otherwise("high")


def language_string(text: Column) -> Column:
    """One letter per hi or en token, h or e: everything about mixing follows from it by string functions.

    Texts without any Devanagari skip the test for it on each token.
    """
    latin = lambda t: F.when(t.rlike(LATIN_WORD), "e").otherwise("")
    both = lambda t: F.when(t.rlike(DEVA), "h").otherwise(latin(t))
    words = tokens(text)
    return F.when(text.rlike(DEVA), F.array_join(F.transform(words, both), "")).otherwise(F.array_join(F.transform(words, latin), ""))


def mixing(letters: Column) -> tuple[Column, Column, Column]:
    """Switches, their density, and the mixing index, from a language string."""
    n, en = F.length(letters), F.length(F.translate(letters, "h", ""))
    switches = F.greatest(F.length(single_runs(letters)) - 1, F.lit(0))
    density = F.when(n < 2, F.lit(0.0)).otherwise(switches / F.greatest(n - 1, F.lit(1)))
    return switches, density, F.when(n == 0, F.lit(0.0)).otherwise(F.least(en, n - en) / F.greatest(n, F.lit(1)))


def english_bucket(n_words: Column) -> Column:
    return F.when(n_words >= 4, "high").when(n_words >= 2, "med").otherwise("low")


def single_runs(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def fold_variants(word: Column) -> Column:
    return single_runs(F.translate(word, "w", "v"))


def drop_final_schwa(text: Column) -> Column:
    keep = lambda w: (F.length(w) > 2) & w.endswith("a") & (F.regexp_count(w, F.lit("[aeiou]")) >= 2)
    return F.array_join(F.transform(tokens(text), lambda w: F.when(keep(w), F.left(w, F.length(w) - 1)).otherwise(w)), " ")


def phonetic(word: Column) -> Column:
    """English and Hindi spellings of a loanword folded; ASCII case only matters."""
    soft = F.regexp_replace(F.translate(F.lower(word), "w", "v"), "c(?=[eiy])", "s")
    hard = F.replace(F.translate(F.regexp_replace(soft, "c(?!h)", "k"), "q", "k"), F.lit("x"), F.lit("ks"))
    return single_runs(F.translate(F.replace(hard, F.lit("ph"), F.lit("f")), "z", "j"))


def skeleton(word: Column) -> Column:
    return F.regexp_replace(phonetic(word), "[aeiou]+", "")


def closeness(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def same_word(a: Column, b: Column, least: float = 0.8) -> Column:
    x, y = skeleton(a), skeleton(b)
    return F.when(a == b, True).when(closeness(a, b) >= least, True).when(closeness(phonetic(a), phonetic(b)) >= least, True).otherwise((F.length(x) >= 2) & (F.length(y) >= 2) & (closeness(x, y) >= least))


def looks_english(word: Column) -> Column:
    return word.rlike("[fqxz]|(tion|ing|ment|able|ness|ful|phone|app)$")


def spells_english(word: Column) -> Column:
    return word.rlike("tion|ing|ment|ous|que|wh|ck$|ed$|ly$") | (word.rlike("[qwxf]") & (F.length(word) > 6))


def english_words(text: Column, stop: list[str]) -> Column:
    plain = F.filter(tokens(text), lambda t: t.rlike(r"^[A-Za-z][A-Za-z'\-]*$") & ~F.lower(t).isin(stop))
    return F.transform(plain, lambda t: F.regexp_replace(F.lower(t), r"^['\-]+|['\-]+$", ""))


def tolerant_member(word: Column, heard: Column) -> Column:
    """Whether some heard word is the word, up to a quarter of its letters (and two in length).

    The bound goes into the distance, which then gives up early; lengths further apart than the bound settle it alone.
    """
    most = F.greatest(F.lit(1), F.floor(F.length(word) / 4))

    def near(h: Column) -> Column:
        off = F.when(most == 1, F.levenshtein(word, h, 1)).when(most == 2, F.levenshtein(word, h, 2)).otherwise(F.levenshtein(word, h))
        return (h == word) | ((F.abs(F.length(h) - F.length(word)) <= F.least(F.lit(2), most)) & off.between(0, most))

    return F.exists(heard, near)


def english_recall(intended: Column, heard: Column) -> Column:
    """Share of the intended words heard; null where none is intended. Each different word is looked up once."""
    near = let(F.array_distinct(heard), lambda h: F.filter(F.array_except(intended, h), lambda w: tolerant_member(w, h)))
    known = F.concat(F.array_intersect(intended, heard), near)
    hits = let(known, lambda k: F.size(F.filter(intended, lambda w: F.array_contains(k, w))))
    return F.try_divide(hits, F.size(intended))


def ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), "\x1f"))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def ngram_repetition(words: Column, n: int) -> Column:
    """Share of n-grams beyond the first of their kind."""
    share = lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.greatest(F.size(g), F.lit(1))
    return F.when(F.size(words) < n, F.lit(0.0)).otherwise(let(ngrams(words, n), share))


def _runs_of(sorted_items: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        x = x.cast("string")
        run = F.when(x.eqNullSafe(s["last"]), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(sorted_items, start, step, lambda s: s["best"])


def longest_run(items: Column) -> Column:
    return _runs_of(items)


def top_ngram_share(words: Column, n: int = 3) -> Column:
    """Share of the commonest n-gram; 0 for fewer than n + 1 words."""
    share = lambda g: _runs_of(g) / F.greatest(F.size(g), F.lit(1))
    return F.when(F.size(words) < n + 1, F.lit(0.0)).otherwise(let(F.sort_array(ngrams(words, n)), share))


def degenerate(text: Column) -> Column:
    """too_short, token_repetition or the empty string."""

    def reason(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 5, "too_short").when(_runs_of(words) >= F.greatest(F.lit(4), F.floor(n / 2)), "token_repetition").otherwise("")

    return let(F.sort_array(tokens(F.lower(text))), reason)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-character pieces of a text without spaces."""
    s = F.replace(text, F.lit(" "), F.lit(""))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < k, F.array(s)).otherwise(many)


def corpus_id(text: Column) -> Column:
    """c and eight hex digits of SHA-1 over the text with single spaces; the text must be NFC."""
    return F.concat(F.lit("c"), F.left(F.sha1(F.array_join(tokens(text), " ")), F.lit(8)))


def clip_id(cid: Column, voice: Column, speed: Column, tier: Column, attempt: Column) -> Column:
    return F.concat(cid, F.lit("__"), voice, F.lit("__sp"), F.bround(speed * 10).cast("int").cast("string"), F.lit("__t"), F.coalesce(tier, F.lit("x")), F.lit("__v"), attempt.cast("string"))


def speech_text(text: Column) -> Column:
    """Quotes dropped, lower case, symbols spelled out, single spaces, as a Hindi tokenizer expects them."""
    spelled = F.lower(F.translate(text, '"', ""))
    for mark, word in (("&", " और "), ("@", " ऐट दी रेट "), ("%", " प्रतिशत "), ("#", " हैश "), ("$", " डॉलर "), ("£", " पाउंड "), ("°", " डिग्री ")):
        spelled = F.replace(spelled, F.lit(mark), F.lit(word))
    return F.trim(F.regexp_replace(spelled, r"\s+", " "))


def harmonic_mean(a: Column, b: Column) -> Column:
    x, y = F.greatest(a, F.lit(1e-6)), F.greatest(b, F.lit(1e-6))
    return 2 * x * y / (x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def max_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def snr_db(signal: Column, other: Column) -> Column:
    noise = F.zip_with(signal, other, lambda x, y: x.cast("double") - y.cast("double"))
    return 10 * F.log10(dot(signal, signal) / F.greatest(dot(noise, noise), F.lit(1e-30)))


def repeat_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen places weakened: divided if positive, multiplied if negative."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def arg_max(items: Column) -> Column:
    return F.array_position(items, F.array_max(items)) - 1


def accept_reason(hyp: Column, rate: Column, seconds: Column, recall: Column, cer: Column, mos: Column | None = None, tau_recall: float = 0.8, tau_cer: float = 0.3, least_s: float = 3.0, most_s: float = 30.0, least_mos: float | None = None) -> Column:
    """The first check that fails, or null. A check whose input is null passes."""
    reason = (
        F.when(F.trim(hyp) == "", "asr_empty").when(rate != 24000, "sr_bad").when(seconds < least_s, "too_short").when(seconds > most_s, "too_long")
        .when(recall < tau_recall, "recall_low").when(cer > tau_cer, "cer_high")
    )
    return reason.when(mos < least_mos, "dnsmos_low") if mos is not None and least_mos is not None else reason


#: Fixed values: (least recall, most CER) by mixing bin; "?" for an unknown one.
BIN_THRESHOLDS = {"none": (0.85, 0.12), "low": (0.83, 0.14), "med": (0.76, 0.20), "high": (0.70, 0.25), "?": (0.75, 0.18)}


def by_bin(bin_: Column, which: int) -> Column:
    """A bin's threshold: 0 for recall, 1 for CER."""
    out = F.lit(BIN_THRESHOLDS["?"][which])
    for name, pair in BIN_THRESHOLDS.items():
        out = F.when(bin_ == name, pair[which]).otherwise(out)
    return out


def regated_reason(bin_: Column, reason: Column, recall: Column, cer: Column) -> Column:
    """The reject reason under the bin's thresholds; objective rejects stay, a null recall fails."""
    hard = reason.isin("too_short", "too_long", "asr_missing") | recall.isNull()
    return F.when(F.coalesce(hard, recall.isNull()), F.coalesce(reason, F.lit("asr_missing"))).when(recall < by_bin(bin_, 0), "recall_low").when(cer > by_bin(bin_, 1), "cer_high")
