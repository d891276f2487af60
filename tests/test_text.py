"""Text rules: golden values and properties."""

import json
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.functions import columns as C
from braidwork.functions import indic, udfs


def test_one_word_in_two_scripts():
    assert indic.recall("coaching center", "कोचिंग सेंटर") >= 0.999
    assert indic.cer("coaching center", "कोचिंग सेंटर") < 0.2 and indic.wer("coaching center", "कोचिंग सेंटर") > 0.5


def test_dropped_content_lowers_recall():
    ref = "मैं coaching center जा रहा हूँ और notebook लेना है"
    assert indic.recall(ref, ref) == 1.0 and indic.recall(ref, "मैं जा रहा हूँ") < 0.5


def test_self_hypothesis():
    for text in ("plain words", "ये coaching center है", "12 3 word, here!", "क़लम फ़िल्म"):
        assert indic.recall(text, text) == 1.0 and indic.cer(text, text) == indic.wer(text, text) == 0.0
    assert indic.recall("", "") == 1.0 and indic.recall("", "x") == 0.0 and indic.cer(None, "x") == 1.0 and indic.cer_spaced("", "") == 1.0


def test_distance_is_levenshtein():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert indic.distance(a, b) == plain(a, b)
        assert indic.distance(a.split("b"), b.split("b")) == plain(a.split("b"), b.split("b"))


def test_romanise():
    assert indic.romanise("सेंटर") == "sentara" and indic.romanise("क्या") == "kyaa" and indic.romanise("ज़रा") == "zaraa"
    assert indic.compare_space("सेंटर 2 Chai!") == "sentar tvo chai" and indic.romanise("") == ""


def test_numbers_and_scripts():
    assert indic.spell_numbers("10am 5 १२बजे 99") == "ten am पाँच बारह बजे 99"
    assert indic.clean("  two   words ") == "two words" and indic.clean("मैंgo") is None and indic.clean(None) is None
    assert indic.repair("ok मैंgo fine।") == "ok fine।"


def test_clauses():
    for text in ("word " * 300, "x" * 700, "One two. " * 80, "a, b; " * 120 + "y" * 400, "", "  "):
        out = indic.clauses(text)
        assert all(0 < len(c) <= 250 for c in out) and "".join("".join(out).split()) == "".join(text.split())


def test_sentences_and_budget():
    assert indic.sentences("Hello there. How are you? Fine! नमस्ते।") == ["Hello there.", "How are you?", "Fine!", "नमस्ते।"]
    text = "a b c d, e f g h. i j k l m n o p"
    out = indic.token_chunks(text, 4)
    assert all(len(c.split()) <= 4 for c in out) and " ".join(out) == text
    assert indic.token_chunks("", 4) == []


def test_mixed_normaliser():
    args = ({"hai": "है"}, {"delhi": "दिल्ली"}, {"main": "मैं"}, {"office", "the"}, {"naam": "नाम"})
    out, spans = indic.mixed_normalise("main office, Delhi naam hai!", *args)
    assert out == "main office, दिल्ली नाम है!" and spans[0] == ("main", "en", "ambig-en")
    assert indic.mixed_normalise("main naam", *args)[0] == "मैं नाम" and indic.mixed_normalise(None, *args) == ("", [])
    assert indic.devanagari("kal") == "कल" and indic.devanagari("dost") == "दोस्त"


def test_seed():
    assert indic.fnv_seed(7, "u1") == indic.fnv_seed(7, "u1") != indic.fnv_seed(7, "u2") and 0 <= indic.fnv_seed(2**31 - 1, "x") < 2**31


def test_columns_agree_with_rules(spark):
    words = ["center", "phone", "scheme", "chai", "queue", "", "xerox", "zzz", "tation", "coffee", "w"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = df.select("a", "b", C.phonetic(F.col("a")).alias("p"), C.skeleton(F.col("a")).alias("s"), C.same_word(F.col("a"), F.col("b")).alias("m"), C.looks_english(F.col("a")).alias("e")).collect()
    for r in got:
        assert (r["p"], r["s"], r["m"], r["e"]) == (indic.phonetic(r["a"]), indic.skeleton(r["a"]), indic.same_word(r["a"], r["b"]), indic.looks_english(r["a"]))


def test_tags_golden(spark):
    df = spark.createDataFrame([("ये coaching center है",), ("",), (None,)], "t string").select(C.language_tags(F.col("t")).alias("g"))
    rows = df.select("g", C.switch_density(F.col("g")).alias("d"), C.mixing_bin(C.mixing_index(F.col("g"))).alias("b")).collect()
    assert rows[0]["g"] == ["hi", "en", "en", "hi"] and rows[0]["d"] == pytest.approx(2 / 3) and rows[0]["b"] == "high"
    assert rows[1]["d"] == 0.0 and rows[1]["b"] == "none"


def test_repetition(spark):
    df = spark.createDataFrame([("a b c a b c a b c",), ("a b c d e",), ("a b",)], "t string").select(C.tokens(F.col("t")).alias("w"))
    rows = df.select(C.ngram_repetition(F.col("w"), 3).alias("r"), C.top_ngram_share(F.col("w"), 3).alias("s"), C.longest_run(F.col("w")).alias("l")).collect()
    assert [r["r"] for r in rows] == [pytest.approx(4 / 7), 0.0, 0.0] and rows[0]["s"] == pytest.approx(3 / 7) and rows[1]["s"] == pytest.approx(1 / 3)


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([("ये center", "ye center"), (None, None), ("", "x")], "a string, b string")
    rows = df.select(udfs.recall("a", "b").alias("r"), udfs.cer("a", "b").alias("c"), udfs.clean("a").alias("k"), udfs.clauses("a").alias("l"), udfs.recall_tagged("a", "b", F.array(F.lit("hi"), F.lit("en"))).alias("t")).collect()
    assert rows[0]["r"] == 1.0 and rows[1]["r"] == 1.0 and rows[2]["r"] == 0.0 and rows[1]["k"] is None and rows[2]["l"] == []
    assert json.dumps(rows[0]["t"]) == "1.0"


def test_english_recall_looks_each_word_up_once(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    rows = [(i, [word() for _ in range(rng.randrange(12))], [word() for _ in range(rng.randrange(12))]) for i in range(60)] + [(60, [], ["a"]), (61, ["a", "a", "zz"], []), (62, ["abcd", "abcd", "q"], ["abce"])]
    heard = lambda w, y: any(w == h or abs(len(w) - len(h)) <= 2 and indic.distance(w, h) <= max(1, len(w) // 4) for h in y)
    want = {i: sum(heard(w, y) for w in x) / len(x) if x else None for i, x, y in rows}
    df = spark.createDataFrame(rows, "i long, x array<string>, y array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", C.english_recall(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got == want


def test_lengths_settle_only_what_distances_would():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        assert indic._near(a, b, 0.8) == (indic.closeness(a, b) >= 0.8)


def test_normaliser_holds_a_portion_of_rows_at_a_time(spark):
    texts = ["x" * 30, None, "", "yz " * 10] * 5 + ["w" * 500]
    got = list(udfs.portions([pa.array(texts[:7]), pa.array(texts[7:], pa.string())], 64))
    assert [t for rows in got for t in rows] == texts and all(len(rows) == 1 or sum(len(t or "") for t in rows) <= 64 for rows in got)
    args = ({"hai": "है"}, {"delhi": "दिल्ली"}, {"main": "मैं"}, {"office", "the"}, {"naam": "नाम"})
    rows = [(i, t) for i, t in enumerate(["main office, Delhi naam hai! " * 3000, None, "", "!!", "Delhi main", "Main", "q" * 200 + " the main"] * 9)]
    norm = udfs.mixed_normaliser(*args)
    for r in spark.createDataFrame(rows, "i long, t string").coalesce(2).select("i", "t", norm("t").alias("n")).collect():
        out, spans = indic.mixed_normalise(r["t"], *args)
        assert r["n"]["out"] == out and [tuple(s) for s in r["n"]["spans"]] == spans


def test_heard_words_are_those_that_same_word_takes(monkeypatch):
    rng = random.Random(8)
    for _ in range(60):
        pool = ["".join(rng.choices("aeickwth", k=rng.randrange(1, 17))) for _ in range(25)]
        bent = ["".join(c if rng.random() > 0.15 else rng.choice(["", "e", "k" + c]) for c in w) or "a" for w in pool]
        heard = indic.Heard(bent)
        assert all(heard.has(w) == any(indic.same_word(w, h) for h in bent) for w in pool)
    tried = []
    monkeypatch.setattr(indic, "same_word", lambda a, b: tried.append((a, b)))
    syllables = [a + b for a in "bdghjklmnprt" for b in "aeiou"]
    want, got = (" ".join(rng.choice(syllables) + rng.choice(syllables) + rng.choice(syllables) for _ in range(300)) for _ in range(2))
    indic.recall(want, got)
    assert len(tried) < 300 * 300 / 10  # not each word against all


def test_pair_scores_fold_each_text_once(monkeypatch):
    pairs = [("coaching center", "कोचिंग सेंटर"), (None, "x"), ("x", None), (None, None), ("", " "), ("the is", "a"), ("कल meeting है 2 w", "kal miting hai do v")]
    assert [indic.pair_scores(a, b) for a, b in pairs] == [(indic.recall(a, b), indic.cer(a, b), indic.wer(a, b), indic.cer_spaced(a, b)) for a, b in pairs]
    folded, fold = [], indic.compare_space
    monkeypatch.setattr(indic, "compare_space", lambda t: folded.append(t) or fold(t))
    indic.pair_scores("a b", "a c")
    assert folded == ["a b", "a c"]


def test_heard_words_match_each_against_all(monkeypatch):
    rng = random.Random(9)
    near = lambda w, h: w == h or abs(len(w) - len(h)) <= 2 and indic.distance(w, h) <= max(1, len(w) // 4)
    bend = lambda w, n: "".join(c if rng.random() > n / len(w) else rng.choice(["", "e", c + c, c + "-"]) for c in w)
    for most in (1, 1 << 20):
        monkeypatch.setattr(indic, "AT_ONCE", most)
        for _ in range(60):
            words = ["".join(rng.choices("abcde'", k=rng.randrange(1, 20))) for _ in range(20)]
            heard = [bend(w, rng.randrange(5)) for w in words] + [""]
            assert indic.heard_words(words, heard) == {w for w in words if any(near(w, h) for h in heard)}
    measured, distance = [], indic.distance
    monkeypatch.setattr(indic, "distance", lambda a, b: measured.append((a, b)) or distance(a, b))
    pick = lambda: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 14))) for _ in range(300)]
    indic.heard_words(pick(), pick())
    assert len(measured) < 300


def test_english_recall_of_texts(spark):
    stop = ["the", "it's"]
    texts = ["The cat's -x x- it's IT'S don\x85go a\xa0b x\x1cy KK İx caf\xe9 q1 zebra''", "", None, "the", "center centre  phones\nfone", "phone center abcdefghij", "bcdefghijk abcdefghij-- abcdefghij"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = df.select("a", "b", C.english_words(F.col("a"), stop).alias("e"), C.english_recall(*[C.english_words(F.coalesce(c, F.lit("")), stop) for c in ("a", "b")]).alias("w"), udfs.english_recall(stop)("a", "b").alias("r")).collect()
    for r in rows:
        assert r["e"] is None or indic.english_words(r["a"], frozenset(stop)) == r["e"]
        assert r["r"] == r["w"]


def test_similarity_of_equal_texts_needs_no_blocks(monkeypatch):
    rng = random.Random(10)
    texts = ["".join(rng.choices("ab cd", k=rng.choice([3, 40, 260]))) for _ in range(40)]
    whole = [indic.compare_space(t) for t in texts]
    assert all(indic.difflib.SequenceMatcher(None, t, t).ratio() == 1.0 for t in whole if t)
    monkeypatch.setattr(indic.difflib, "SequenceMatcher", None)
    assert [indic.similarity(t, t) for t in texts] == [1.0 if not t or c else 0.0 for t, c in zip(texts, whole, strict=True)]


def test_similar_settles_what_similarity_does(monkeypatch):
    rng = random.Random(11)
    letters = "aab cdeiw 1.éñ́कखािी़्ं\n"
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 12, 60, 260]))) for _ in range(300)]

    def near(text):
        out = list(text)
        for _ in range(rng.randrange(1 + len(out) // 2)):
            out[rng.randrange(len(out))] = rng.choice(letters)
        return "".join(out)

    pairs = [(t, rng.choice([t, near(t), rng.choice(texts), t[: len(t) // 3], None])) for t in texts] + [(None, None), (None, "a"), ("...", "...")]
    whole = [indic.similarity(a, b) for a, b in pairs]
    for least in (0.2, 0.55, 0.8):
        assert [indic.similar(a, b, least) for a, b in pairs] == [s >= least for s in whole]
    assert all(indic.similar(a, b, s) for (a, b), s in zip(pairs, whole, strict=True))  # the bound itself counts
    assert 20 < sum(0.55 <= s < 1 for s in whole) and 50 < sum(s < 0.55 for s in whole)
    monkeypatch.setattr(indic.difflib, "SequenceMatcher", None)
    assert not indic.similar("abc " * 10, "cba dec " * 30, 0.55)  # lengths settle it


def test_single_runs_and_marks_of_compare_space():
    rng = random.Random(12)
    for _ in range(500):
        text = "".join(rng.choices("aabw  é́̈ñ漢漢😀कि\n", k=rng.randrange(30)))
        folded = indic.compare_space(text)
        assert folded == indic.single_runs(folded) and not any(map(unicodedata.combining, folded))
        line = text.replace("\n", "")
        assert indic._single_runs_of_line(line) == indic.single_runs(line)
