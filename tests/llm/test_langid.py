import math
import random
import zlib

import numpy as np
import pytest

from readloom.llm import langid


def test_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op3_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held)
    assert right / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_and_rejection(spark, odd):
    en, de = "the cat and the dog were in the house of the man ", "der hund und die katze waren in dem haus des mannes "
    rows = [(i, en * (1 + i % 3) if i % 2 else de * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pure, mixed, none = model.predict([en * 3, en * 6 + de * 3, "123 !?"])
    assert pure[:2] == ("en", 1.0) and none == ("und", 0.0, {})
    assert mixed[0] == "en" and set(mixed[2]) == {"en", "de"} and 0.5 < mixed[1] < 0.85
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, None, 11, 12}
    assert [r.lang_pred for r in langid.identify(odd.filter("text is null or text = ''"), model).collect()] == ["und"] * 3
    assert langid.identify(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark, odd):
    model = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(odd, model).collect()} == {"und"}


def test_model_does_not_read_held_out_rows(spark):
    rows = [(i, "aaa bbb", "x") for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == []


def plain(model, text):
    """Proportions by EM and the set by penalised likelihood, word by word, as the module says."""
    words = [w for w in "".join(c.lower() if c.isalpha() else " " for c in text).split()]
    words = [w[i : i + langid.UNIT] for w in words for i in range(0, len(w), langid.UNIT)]
    if not words:
        return "und", {}
    k, ll = len(model.langs), model._likelihoods([text])[0].tolist()
    assert len(ll) == len(words)

    def em(pi, rounds):
        for _ in range(rounds):
            sums = [0.0] * k
            for row in ll:
                top = max(row)
                r = [math.exp(x - top) * q for x, q in zip(row, pi)]
                sums = [s + x / sum(r) for s, x in zip(sums, r)]
            pi = [s / len(ll) for s in sums]
        return pi, sum(max(row) + math.log(sum(math.exp(x - max(row)) * q for x, q in zip(row, pi))) for row in ll)

    pi, _ = em([1 / k] * k, langid.ROUNDS)
    order = sorted(range(k), key=lambda j: -pi[j])
    best, score = [float(j == order[0]) for j in range(k)], sum(row[order[0]] for row in ll)
    for size in range(2, k + 1):
        if pi[order[size - 1]] < langid.LEAST:
            break
        total = sum(pi[j] for j in order[:size])
        fit, value = em([pi[j] / total if j in order[:size] else 0.0 for j in range(k)], langid.AGAIN)
        value -= (size - 1) * (0.5 * math.log(max(len(ll), 2)) + 2.0)
        if value > score:
            best, score = fit, value
    return model.langs[max(range(k), key=lambda j: best[j])], {model.langs[j]: x for j, x in enumerate(best) if x > 0}


def test_mixture_is_that_of_the_plain_form(spark, docs):
    by_lang = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        if r.text and r.lang:
            by_lang.setdefault(r.lang, []).append(r.text[:400])
    rows = [(i, t, lang) for lang, texts in by_lang.items() for i, t in enumerate(texts[:12])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    r = random.Random(2)
    texts = [" ".join(r.choice(by_lang[lang])[: r.randrange(20, 300)] for lang in r.choices(list(by_lang), k=r.randrange(1, 4))) for _ in range(40)] + ["", "1 2", "a"]
    for text, (name, score, mixture) in zip(texts, model.predict(texts)):
        want, proportions = plain(model, text)
        assert name == want and set(mixture) == set(proportions)
        assert score == pytest.approx(proportions.get(name, 0.0), abs=1e-6) and all(mixture[x] == pytest.approx(proportions[x], abs=1e-6) for x in mixture)


def test_copies_of_one_text_do_not_decide_what_is_learned(spark, monkeypatch):
    rows = [(i, "der hund und die katze" if i % 10 else f"das haus nummer{i}", "de") for i in range(3000)] + [(9000 + i, f"the house {i}", "en") for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled, per_language=200)
    assert model.langs == ["de", "en"] and all(np.ptp(model.logp[:, j]) > 1 for j in (0, 1))
    monkeypatch.setattr(langid, "MOST_LANGS", 1)
    with pytest.raises(ValueError):
        langid.train(labelled)
