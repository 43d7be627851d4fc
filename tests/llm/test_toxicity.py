"""The toxicity classifier by held-out accuracy, and on odd rows."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from odweave.llm import queries, toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op7_toxicity(spark, d).toPandas()
    assert len(out) == 10_000 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    both = out.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.98
    assert (held.predicted[held.toxic == 0] == 0).mean() > 0.99
    ranks = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (ranks[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.98


def grams(text):
    """The distinct n-grams of a text, in plain Python."""
    words = "".join(c if unicodedata.category(c)[0] in "LMN" or ord(c) > 0xFFFF else " " for c in text.lower()).split()
    return {f" {w} "[i : i + k] for w in words for k in toxicity.SIZES for i in range(len(w) + 3 - k)}


@given(st.text(alphabet="abAé é,.\n。天地́😀1", max_size=40))
def test_features_are_the_distinct_ngrams(text):
    last = np.zeros(1 << toxicity.BITS, np.int32)
    own = toxicity.features(text, last)
    assert len(own) == len(set(own.tolist())) == len(grams(text))


def test_every_part_of_a_text_is_read():
    of = lambda t: set(toxicity.ngrams(t).tolist())
    for a, b in (("wonderful", "wondarful"), ("abcdefghijklmno", "abcdefghijklmnX"), ("天地玄黄宇宙洪荒" * 500 + "日月盈昃", "天地玄黄宇宙洪荒" * 500 + "日月盈亏")):
        assert of(a) - of(b) and of(b) - of(a)
    text = "".join(chr(0x4E00 + i) for i in range(3000))
    assert len(toxicity.ngrams(text)) == sum(3000 + 3 - k for k in toxicity.SIZES)
    assert of("天地玄黄。宇宙洪荒") == of("天地玄黄 宇宙洪荒")
    inner = lambda w: {g for g in grams(w) if " " not in g}
    assert inner("horrid") <= grams("prehorrids")


def plain_model(texts, toxic):
    """(ratio of each n-gram, values of each training text) by the docstring's words."""
    sets = [grams(t) for t in texts]
    count = [Counter(g for s, y in zip(sets, toxic, strict=True) if y == c for g in s) for c in (1, 0)]
    total = [sum(c.values()) for c in count]
    prior = [toxicity.SMOOTHING * 2 * t / sum(total) for t in total]
    ratio = lambda g, a=0, b=0: math.log((count[0][g] - a + prior[0]) / (count[1][g] - b + prior[1])) - math.log(prior[0] / prior[1])
    values = []
    for s, y in zip(sets, toxic, strict=True):
        v = {g: ratio(g, y, 1 - y) for g in s}
        norm = sum(x**4 for x in v.values()) ** 0.25
        values.append({g: x / norm for g, x in v.items()})
    return {g: ratio(g) for s in sets for g in s}, values


def test_fit_and_score_against_plain_python(spark, documents):
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(3, 8))) for _ in range(60)]
    texts = [" ".join([*r.choice(words, 12), *(["horrid"] * (i % 3 == 0))]) for i in range(90)]
    toxic = [int(i % 3 == 0) for i in range(90)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5][:90]
    docs = documents(list(zip(ids, texts, strict=True)))
    model = toxicity.train(docs, spark.createDataFrame(list(zip(ids, toxic, strict=True)), "doc_id long, toxic int"))
    flat = np.frombuffer(model, "<f4")
    bias, (weight, ratios) = float(flat[0]), flat[1:].reshape(2, -1)
    ratio, values = plain_model(texts, toxic)
    last = np.zeros(1 << toxicity.BITS, np.int32)
    # of the n-grams of a word of six letters the whole word is the last but one
    place = {g: int(toxicity.ngrams(g)[-2]) for g in ratio if " " not in g and len(g) == 6}
    assert all(abs(ratios[k] - ratio[g]) < 1e-4 for g, k in place.items())
    hashed = lambda t: toxicity.features(t, last).tolist()
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    for i, t in zip(ids, texts, strict=True):
        norm = sum(ratio[g] ** 4 for g in grams(t)) ** 0.25
        assert abs(got[i] - 1 / (1 + math.exp(-bias - sum(float(weight[k]) for k in hashed(t)) / norm))) < 1e-5
    # the weights are a minimum: the gradient of the plain loss, by the values of training texts, is near 0
    share = [0.5 / (30 if y else 60) for y in toxic]
    scores = []
    for t, v in zip(texts, values, strict=True):
        norm = sum((ratio[g]) ** 4 for g in grams(t)) ** 0.25
        assert norm > 0 and v
        scores.append(bias + sum(float(weight[k]) for k in hashed(t)) / norm)
    assert abs(sum(w * (1 / (1 + math.exp(-z)) - y) for w, z, y in zip(share, scores, toxic, strict=True))) < 0.05
    assert all((z > 0) == bool(y) for z, y in zip(scores, toxic, strict=True))


def test_terms_inside_compounds_and_at_the_end_of_long_texts(spark, documents):
    rows = [(i, f"you {w} {i}" if i % 2 else f"a {f} day {i}") for i, (w, f) in enumerate([("bastardly", "wonderful")] * 80)]
    long = "天地玄黄宇宙洪荒" * 5
    toxic = [(200, "megabastardly"), (201, long + "bastardly")]
    clean = [(300, "megawonderful"), (301, long + "wonderful")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(documents(rows), labels)
    got = {r.doc_id: r.score for r in toxicity.score(documents(toxic + clean), model).collect()}
    assert min(got[200], got[201]) > 0.5 > max(got[300], got[301])


def test_odd_rows(spark, documents):
    rows = [(i, "you awful fool" if i % 2 else "a fine day") for i in range(40)]
    rows += [(50, None), (51, ""), (None, "you awful fool"), (1, "you awful fool"), (52, "fine day " * 20_000)]
    docs = documents(rows)
    labels = spark.createDataFrame([*((i, i % 2) for i in range(40)), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.text and "fool" in r.text:
            assert r.score > 0.5
        elif r.text:
            assert r.score < 0.5
    assert len({r.score for r in out if not r.text}) == 1
    assert toxicity.score(documents([]), toxicity.train(docs, labels)).count() == 0
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
