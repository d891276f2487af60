import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidwork.llm import compression

from .test_basic import brute_mix, check_copies
from .test_hyperminhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    line = "all the shared words of a footer line"
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    out = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randint(30, 240))
        text = "\n".join(" ".join(words[a : a + 20]) for a in range(0, len(words), 20))
        if i % 3 == 0:
            text += "\n" + line
        if i % 9 == 5:
            text = "spam egg " * 90
        out.append((i, text, "en", f"s{i % 14}", len(text)))
    for i in range(20):
        k = rng.randrange(60)
        words = out[k][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words), "en", f"s{i % 14}", 0))
    return [*out, (500, None, "en", "s1", None), (501, "", None, None, 0)]


def brute_lines(rows):
    sites, first = defaultdict(set), {}
    for i, text, _, source, _ in sorted(rows):
        for pos, x in enumerate((text or "").split("\n")):
            if x.strip():
                sites[x].add(source)
                first.setdefault(x, (i, pos))
    out = []
    for i, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        left = [x for p, x in enumerate(lines) if not x.strip() or len(sites[x]) < 10 or first[x] == (i, p)]
        new = None if text is None else "\n".join(left)
        out.append((i, new, lang, source, n if new == text else len(new)))
    return out


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    judge = compression._Judge(compression.Bands())
    want = [r for r in rows if compression._measures(r[1], judge)[6]]
    assert 40 < len(want) < len(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name == "line_dedup":
            want = brute_lines(want)
        if name == "near_dedup":
            kept = {i for i, _, _, good in brute([r[0] for r in want], [r[1] for r in want], 5, 80) if good}
            assert len(kept) < len(want)
            want = [r for r in want if r[0] in kept]
        if name == "mix_sources":
            words = {r[0]: len((r[1] or "").split()) for r in want}
            taken, _, _, _ = brute_mix([(r[0], r[1], r[3]) for r in want])
            copies = Counter(r["doc_id"] for r in docs.collect())
            check_copies([(r[0], r[3], words[r[0]]) for r in want], copies, taken)
            want = [r for r in want for _ in range(copies[r[0]])]
        if name != "pack_sequences":
            assert docs.columns == before.columns
            assert Counter(map(tuple, docs.collect())) == Counter(want)
    lengths = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in lengths) <= 1024
    assert {r["doc_id"] for r in docs.collect()} == {r[0] for r in want}


def test_run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 10
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/e").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text, ties, and extra columns with clashing names, stage by stage."""
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n // 12))
    long = text(300_000)
    plain, twin = text(240), text(360)
    odd = [(1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (2, twin, None, None, None), (3, twin, "en", "a", 5), (None, text(240), "en", "b", 7), (None, None, None, None, None), (5, "", "en", "", 0), (6, None, "en", "b", None), (7, long, "en", "b", len(long)), (8, " \n\t", "en", "b", 3)]
    rows = [(*r, "x", 2, "y", 3) for r in odd]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, _id string, size int, _tag string, key int").repartition(3)
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "pack_sequences":
            assert docs.columns == columns
        seen.append(Counter(r["doc_id"] for r in docs.collect()))
    assert seen[0] == seen[1] == Counter({1: 2, 2: 1, 3: 1, None: 1, 7: 1})
    assert seen[2] == Counter({1: 1, 2: 1, None: 1, 7: 1})
    assert set(seen[3]) <= {1, 2, None, 7} and seen[3][7] >= 1 and max(seen[3].values()) <= 2
    assert set(seen[4]) == set(seen[3]) and seen[4][7] > 100
    for name, stage in corpus_pipeline.STAGES:  # every stage alone on the odd rows
        alone = stage(spark, spark.createDataFrame(rows, f"{SCHEMA}, _id string, size int, _tag string, key int"), "").collect()
        assert len(alone) >= 4, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], f"{SCHEMA}, _id string, size int"), "").count() == 0, name
