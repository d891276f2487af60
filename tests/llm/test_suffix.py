import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidwork.llm import passages, suffix
from braidwork.llm.scratch import Scratch


def brute(texts, width):
    """(bytes, removed, runs, digest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(rng, width, n):
    letters = "abé\0 \n"
    shared = ["".join(rng.choices("abcdefgh ", k=rng.randint(width // 2, 3 * width))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice([rng.choice(shared), "".join(rng.choices(letters, k=rng.randint(0, width))), rng.choice("ab") * rng.randint(1, 2 * width), "xyz" * rng.randint(1, width)]))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("width", [24, 37, 64, 400])
def test_suffix_array_finds_all_windows(width):
    rng = random.Random(width)
    for _ in range(15):
        parts = [t.encode() for t in corpus(rng, width, rng.randint(1, 12))]
        seen = Counter(p[i : i + width] for p in parts for i in range(len(p) - width + 1))
        want = [[seen[p[i : i + width]] > 1 for i in range(len(p) - width + 1)] for p in parts]
        assert [m.tolist() for m in suffix.repeated(parts, width)] == want


def test_order_and_prefixes():
    rng = random.Random(8)
    parts = ["".join(rng.choices("ab", k=200)).encode() for _ in range(3)]
    starts = np.concatenate([np.arange(i * 201, i * 201 + 161) for i in range(3)])
    blob = b"\0".join(parts) + b"\0"
    order = suffix.suffix_order(parts, starts, 40)
    heads = [blob[i : i + 40] for i in order]
    assert sorted(order) == sorted(starts) and heads == sorted(heads)
    lcp = suffix.common_prefixes(blob, order, 40)
    for a, b, n in zip(heads, heads[1:], lcp, strict=False):
        assert next((k for k in range(40) if a[k] != b[k]), 40) == n


def test_segments_part_the_windows():
    rng = random.Random(1)
    for n in (0, 399, 400, 5000, 130_000):
        data = bytes(rng.choices(range(97, 123), k=n))
        first, count, _ = suffix.segments(data)
        assert count.sum() == max(0, n - 399) and (first[1:] == first[:-1] + count[:-1]).all()
        assert not len(count) or count.max() <= 400 - suffix.GRAM + 1


@pytest.mark.parametrize("limit", [4_000, 2])
def test_suffix_dedup(spark, limit):
    width = 40
    rng = random.Random(limit)
    texts = [None, "", "short", *corpus(rng, width, 60), "q" * 3000, "long " * 2000 + "x" * 77]
    texts += [texts[5], texts[7], texts[-1]]
    rows = [(i if i != 9 else None, t, "n") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, mini string").repartition(3)
    got = Counter(map(tuple, suffix.suffix_dedup(spark, df, width=width, limit=limit, words=5).collect()))
    shared = brute_passages([r[1] for r in rows], 5)
    want = Counter((r[0], *x, x[1] > 0, p) for r, x, p in zip(rows, brute([r[1] for r in rows], width), shared, strict=True))
    assert got == want


def brute_passages(texts, width):
    """Whether each text holds `width` words in a row that another row's text holds too."""
    raw = [(t or "").encode().split() for t in texts]
    seen = defaultdict(set)
    for i, words in enumerate(raw):
        for a in range(len(words) - width + 1):
            seen[tuple(words[a : a + width])].add(i)
    return [any(len(seen[tuple(w[a : a + width])]) > 1 for a in range(len(w) - width + 1)) for w in raw]


@pytest.mark.parametrize("width", [5, 12, 51])
def test_passages(spark, width):
    """Planted passages of just enough and just too few words, copies, self-repeats and separators of all kinds, by brute force."""
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(3 * width)]
    word = lambda: rng.choice(vocabulary)
    planted = [[word() for _ in range(rng.choice([width - 1, width, width + 1, 2 * width]))] for _ in range(12)]
    texts = [None, "", " ", "few words"]
    for _ in range(150):
        words = [word() for _ in range(rng.choice([0, width // 2, width - 1, width, 3 * width]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(planted)
        if rng.random() < 0.1:
            words = words * 2
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words))
    texts += rng.choices(texts, k=10)
    df = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string").repartition(3)
    own = df.selectExpr("doc_id as _id", "coalesce(xxhash64(text), 0) as _tag", "text as _text")
    found = {r["_tag"] for r in passages.documents_with_passages(Scratch(spark, "t"), own, width).collect()}
    tags = [r["_tag"] for r in sorted(own.selectExpr("_tag", "_text").collect(), key=str)]
    by_text = {r["_text"]: r["_tag"] for r in own.collect()}
    want = brute_passages(texts, width)
    assert len(tags) == len(texts) and {by_text[t] in found for t, p in zip(texts, want, strict=True) if p} == {True}
    assert not any(by_text[t] in found for t, p in zip(texts, want, strict=True) if not p) and sum(want) not in (0, len(want))


def test_selection_holds_in_parts():
    rng = np.random.Generator(np.random.PCG64(1))
    grams = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    whole = passages.selected(grams, 26)
    held, passages.PART = passages.PART, 500
    try:
        assert np.array_equal(passages.selected(grams, 26), whole)
    finally:
        passages.PART = held
    assert max(np.diff(whole)) <= 26 and len(passages.selected(grams[:26], 26)) == 1


def test_passages_of_many_words_and_a_long_text(spark):
    """A passage in two documents is found where it has 400 bytes; clean documents stay whole; so does a text of a megabyte."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (70, 80, 120)]
    rows, planted = [], set()
    for i in range(60):
        own = [word() for _ in range(150)]
        if i % 3 == 0:
            own[60:60] = [passages[i // 3 % 3]]
            planted.add(i)
        rows.append((i, " ".join(own)))
    rows.append((99, " ".join(word() for _ in range(160_000))))
    got = {r["doc_id"]: r for r in suffix.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["has_repeats"]} == planted
    assert got[99]["n_bytes"] > 1_000_000 and got[99]["kept_sha256"] == hashlib.sha256(rows[-1][1].encode()).hexdigest()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.suffix_dedup(spark, df).count() == 0


def test_groups_of_batches():
    import pyarrow as pa

    from braidwork.llm.grouped import runs

    rng = random.Random(3)
    for least in (0, 50, 500):
        keys = sorted(rng.choices(range(9), k=100))
        rows = list(enumerate(keys))
        batches = [pa.RecordBatch.from_pydict({"k": [k for _, k in rows[i : i + 7]], "v": [v for v, _ in rows[i : i + 7]]}) for i in range(0, 100, 7)]
        out = [t.to_pydict() for t in runs(batches, 1, least)]
        assert [v for t in out for v in t["v"]] == list(range(100))
        where = defaultdict(set)
        for i, t in enumerate(out):
            for k in t["k"]:
                where[k].add(i)
        assert all(len(x) == 1 for x in where.values())
        if least == 0:
            assert all(len(set(t["k"])) == 1 for t in out)
