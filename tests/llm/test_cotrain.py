import random

import numpy as np
import pytest

from braidwork.llm import cotrain
from braidwork.llm.columns import sieve

SCHEMA = "doc_id long, text string, lang string, source string, label int, score string"


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 200))]
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else words[:3] * (len(words) // 3)
        out.append((i, " ".join(words), "en", f"s{rng.randrange(4) if good else rng.randrange(2, 6)}", int(good), "x"))
    return out


@pytest.fixture(scope="module")
def data():
    return rows(900)


def test_held_out_accuracy(spark, data):
    docs = spark.createDataFrame(data, SCHEMA)
    labels = docs.where("doc_id < 400").selectExpr("doc_id", "label as quality")
    got = {r["doc_id"]: r for r in cotrain.classify(docs, labels, cotrain.Plan(labelled=300, per_round=60)).collect()}
    rest = [r for r in data if r[0] >= 400]
    assert np.mean([got[r[0]]["kept"] == bool(r[4]) for r in rest]) > 0.95
    assert np.mean([(got[r[0]]["meta_score"] >= 0.5) == bool(r[4]) for r in rest]) > 0.6
    again = {r["doc_id"]: r["score"] for r in cotrain.classify(docs.repartition(5), labels, cotrain.Plan(labelled=300, per_round=60)).collect()}
    assert all(again[k] == pytest.approx(v["score"], abs=1e-9) for k, v in got.items())


def test_views_teach_each_other(spark, data):
    """Both views receive labels of both classes, and the rounds lower the errors of the weaker view on the rest."""
    docs = spark.createDataFrame(data, SCHEMA)
    labels = docs.where("doc_id < 150").selectExpr("doc_id", "label as quality")
    rest = {r[0]: bool(r[4]) for r in data if r[0] >= 150}
    errors = {}
    for rounds in (0, 3):
        plan = cotrain.Plan(labelled=150, per_round=60, rounds=rounds)
        model = cotrain.train(docs, labels, plan=plan)
        got = {r["doc_id"]: r for r in cotrain.score(docs, model).collect()}
        errors[rounds] = [sum((got[i][name] >= 0.5) != good for i, good in rest.items()) for name in ("text_score", "meta_score", "score")]
    assert len(model.handed) == 12 and all(n > 50 for *_, n in model.handed)
    assert 2 * errors[3][0] < errors[0][0] and max(errors[3]) < 0.03 * len(rest), errors


def test_hot_ids_stay_within_the_bound(spark, data):
    """One id on most rows, and one text on most rows: what is learnt from is bounded in rows."""
    hot = [(7, f"the same id again {i} " * 9, "en", "s0", 1, "x") for i in range(2000)] + [(9000 + i, "one text " * 40, "en", f"s{i % 3}", 0, "x") for i in range(1500)]
    docs = spark.createDataFrame([*data[:300], *hot], SCHEMA)
    labels = spark.createDataFrame([*[(r[0], r[4]) for r in data[:100]], (9000, 0)], "doc_id long, quality int")
    plan = cotrain.Plan(labelled=90, per_round=20)
    own = docs.selectExpr("doc_id as _id", "xxhash64(text) as _tag", "text as _text", "lang as _lang", "source as _source")
    wanted = own.where("_id = 7").selectExpr("_id as _i", "_tag as _t", "1 as more").distinct()
    assert len(cotrain._collected(own, wanted, 90)[0]) == 90
    model = cotrain.train(docs, labels, plan=plan)
    assert model is not None and all(n <= 20 * k for k, _, _, n in model.handed)
    assert cotrain.score(docs, model).count() == 3800


def test_edges(spark, data):
    odd = [(None, "some text", None, None, 0, "x"), (5000, None, "en", "a", 0, "x"), (5001, "", None, "a", 0, None), (5002, " \n", "en", None, 0, "x"), (5003, "A b " * 50_000, "en", "a", 0, "x")]
    docs = spark.createDataFrame([*data[:200], *odd, odd[0]], SCHEMA)
    labels = spark.createDataFrame([*[(r[0], r[4]) for r in data[:200]], (0, None), (None, 1), (1, 0), (99999, 1)], "doc_id long, quality int")
    got = cotrain.classify(docs, labels).collect()
    assert len(got) == 206
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["score"] == 0 and not by[i]["kept"] for i in (5000, 5001, 5002)) and 0 < by[5003]["score"] < 1
    none = cotrain.classify(docs, labels.where("quality > 5")).collect()
    assert all(r["kept"] for r in none if r["doc_id"] not in (5000, 5001, 5002))
    assert cotrain.classify(docs.limit(0), labels).count() == 0


def test_sieve(spark):
    ids = spark.range(0, 200_000, 7)
    df = spark.range(200_000).withColumnRenamed("id", "k").selectExpr("k", "k as _p")
    kept = {r["k"] for r in sieve(df.select("k"), "k", ids).collect()}
    assert set(range(0, 200_000, 7)) <= kept and len(kept) < 1.01 * 200_000 / 7
    small = {r["k"] for r in sieve(df.select("k"), "k", ids, bits=1 << 15).collect()}
    assert set(range(0, 200_000, 7)) <= small
