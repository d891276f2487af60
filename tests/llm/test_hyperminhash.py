import random
import re
from collections import Counter

import numpy as np
import pytest

from braidwork.llm import hyperminhash as hm
from braidwork.llm.components import components
from braidwork.llm.scratch import Scratch


def word_sets(texts, k):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(k, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def brute(ids, texts, k, percent):
    sets = word_sets(texts, k)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True)}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(["zap", "Éa", "the", "NEW"])
        out.append(" ".join(words))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one two", "two one", "a b c", "A B c"]
    for n in (3, 5, 12, 40, 150, 600):
        base = rng.choices(vocabulary, k=n)
        texts += family(rng, base, 25, max(1, n // 12))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(60)]
    texts += rng.choices(texts, k=30)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent", "largest"), [(3, 85, 3000), (5, 80, 3000), (3, 85, 7)])
def test_near_duplicates(spark, k, percent, largest):
    texts = corpus(k + largest)
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n long, root string").repartition(3)
    got = hm.near_duplicates(spark, df, k, percent, largest=largest).drop("text_tag").collect()
    assert {tuple(r) for r in got} == brute(ids, texts, k, percent) and len(got) == len(texts)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, "a b c"), (2, "a b c"), (3, "x y z"), (4, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in hm.near_duplicates(spark, df).collect())
    assert got == Counter({(1, 1, True): 3, (None, None, True): 1, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 1})
    assert sorted(r["doc_id"] or 0 for r in hm.deduplicated(spark, df).collect()) == [0, 1, 4]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hm.near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize("n", [4000, 300, 100])
def test_estimates(n):
    rng = np.random.Generator(np.random.PCG64(1))
    for share in (0.0, 0.5, 0.85):
        errors = []
        for _ in range(60):
            both = round(2 * n * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
            errors.append(hm.estimate(hm.registers(a), n, hm.registers(b)[None], np.array([n]))[0][0] - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02


def pair(rng, n, percent):
    """Two sets, the one of n, as similar as the threshold just allows."""
    m = rng.integers(max(1, -(-n * percent // 100)), n + 1)
    both = -(-percent * (n + m) // (100 + percent))
    if both > m:
        m, both = n, -(-percent * 2 * n // (100 + percent))
    pool = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n + m - both).astype(np.uint64)
    return np.sort(pool[:n]), np.sort(pool[n - both :])


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_at_the_threshold(percent):
    """Of pairs that barely reach the threshold, hardly any shares no band or fails the estimate, whatever the size."""
    rng = np.random.Generator(np.random.PCG64(percent))
    missed = tested = 0
    for n in (6, 7, 8, 10, 13, 20, 35, 60, 100, 130, 180, 256, 400, 1000, 5000):
        for _ in range(400):
            a, b = pair(rng, n, percent)
            if np.array_equal(a, b):
                continue
            x, y = hm.registers(a), hm.registers(b)
            near = hm.plausible(x, len(a), y[None], np.array([len(b)]), percent)[0][0]
            tested += 1
            missed += not near or not (hm.band_keys(x) == hm.band_keys(y)).any()
    assert tested > 4500 and missed <= 2, (missed, tested)


def test_small_sets_have_no_near_ones():
    for percent in (80, 85):
        for n in range(1, 12):
            near = any(100 * min(n, m) >= percent * max(n, m) for m in range(1, 30) if m != n) or any(100 * i >= percent * (2 * n - i) for i in range(n))
            assert hm.linkable(n, percent) == near


def test_full_sets_tell_words_apart():
    rng = random.Random(3)
    for k in (1, 3, 5):
        texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice([3, 40, 5000]))], k=rng.choice([0, 1, 2, 4, 6, 300]))) for _ in range(60)]
        sets, want = hm.full_sets([hm.words_of(t) for t in texts], k), word_sets(texts, k)
        for i in range(60):
            assert len(sets[i]) == len(want[i]) == len(hm.shingles(hm.words_of(texts[i]), k))
            for j in range(60):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_structured_words_do_not_collide(spark):
    """Words that a polynomial hash modulo a power of two confuses."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    other = x.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{x} one two three"), (2, f"{other} one two three"), (3, f"{x} one two three")]
    got = {r["doc_id"]: r["component_id"] for r in hm.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_very_long_texts(spark):
    rng = random.Random(8)
    words = [f"v{rng.randrange(60_000)}" for _ in range(200_000)]
    near = [*words[:100_000], "changed", *words[100_001:]]
    df = spark.createDataFrame([(4, " ".join(words)), (5, " ".join(near)), (6, " ".join(words[:150_000]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hm.near_duplicates(spark, df, 5, 80).collect()}
    assert got == {4: (199_996, 4), 5: (199_996, 4), 6: (149_996, 6)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    rng.shuffle(edges)
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {(r["node"], r["root"]) for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root if find(x) != x}
