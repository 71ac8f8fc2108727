import hashlib
import random
import re

import pytest

from readloom.llm import fingerprint
from tests.llm import brute


def edited(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.append((i, len(t), brute.sha(t[: len(t) - q] + nxt[:q])))
    return out


def units(text):
    unspaced = fingerprint.UNSPACED.replace("x{20000}", "U00020000").replace("x{3FFFF}", "U0003FFFF")
    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        for part in re.findall(f"[{unspaced}]|[^{unspaced}]+", word):
            out += [part] if len(part) <= fingerprint.LONGEST else list(part)
    return out


def plain(spark, texts, k=fingerprint.K):
    """[(anchor, place), ...] of each text, by the definition; the hashes are Spark's."""
    from pyspark.sql import functions as F

    all_units = sorted({u for t in texts for u in units(t)})
    h = {r.u: r.h for r in spark.createDataFrame([(u,) for u in all_units] or [("",)], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    grams = []
    for t in texts:
        x = [h[u] for u in units(t)]
        at = [i for i in range(len(x) - k + 1) if min(x[i], x[i + k - 1]) == min(x[i : i + k])] if len(x) >= k else [0] if x else []
        grams.append([(x[i : i + k], i) for i in at])
    every = sorted({tuple(g) for found in grams for g, _ in found})
    rows = spark.createDataFrame([(list(g),) for g in every] or [([0],)], "g array<long>")
    short = {tuple(r.g): r.a for r in rows.select("g", F.when(F.size("g") < k, F.hash("g")).otherwise(F.hash(*[F.get("g", F.lit(i)) for i in range(k)])).alias("a")).collect()}
    return [[(short[tuple(g)], p) for g, p in found] for found in grams]


def digits(found):
    return "".join(f"{p - (found[i - 1][1] if i else 0)}{a & 0xFFFFFFFF:08x}" for i, (a, p) in enumerate(found))


def alike(x, y):
    first = [{}, {}]
    for side, found in zip(first, (x, y)):
        for a, p in found:
            side.setdefault(a, p)
    both = sorted((first[0][a], first[1][a] - first[0][a]) for a in first[0] if a in first[1])
    matched = sum(len(both) == 1 or i > 0 and both[i - 1][1] == s or i + 1 < len(both) and both[i + 1][1] == s for i, (_, s) in enumerate(both))
    of = len({*first[0], *first[1]})
    return matched / of if of else 1.0


def check(spark, rows, got):
    """``rows`` (doc_id, text) in order, ``got`` in the same."""
    texts = [t or "" for _, t in rows]
    changed = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    own, other = plain(spark, texts), plain(spark, changed)
    for i, r in enumerate(got):
        assert (r.fingerprint, r.edited_fingerprint) == (digits(own[i]), digits(other[i]))
        assert r.near_edited == pytest.approx(alike(own[i], other[i])) and r.near_next == pytest.approx(alike(own[i], own[(i + 1) % len(own)]))


def test_brute_force(spark):
    r = random.Random(7)
    word = lambda: r.choice(["the", "of", "and", f"w{r.randrange(40)}", "x" * r.randrange(1, 40), "".join(chr(r.randrange(0x4E00, 0x4E30)) for _ in range(r.randrange(1, 30))), "\U00020010e\u0301", "ก่อน"])
    texts = [" ".join(word() for _ in range(r.choice([0, 1, 3, 4, 5, 20, 80]))) for _ in range(60)]
    texts += ["same words as before " * 8] * 2 + [texts[5] + " " + texts[9], texts[9] + "\t" + texts[5], None, "", " \n", "a", "a b c d", "ü" * 400]
    rows = list(enumerate(texts))
    check(spark, rows, sorted(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_brute_force_on_the_corpus(spark, docs):
    rows = docs[:60]
    check(spark, rows, sorted(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_one_character_in_front_changes_little(spark):
    r = random.Random(3)
    chinese = "".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(2000))
    english = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(300))
    joined = "".join(r.choice("abcdefghijklmnop0123456789") for _ in range(2000))
    for text in (chinese, english, joined):
        rows = [(1, text), (2, "x" + text), (3, "ab " + text)]
        got = sorted(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert all(x.near_next > 0.95 for x in got)


def test_moved_passages_count_and_scattered_phrases_do_not(spark):
    words = [f"w{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    r = random.Random(1)
    phrases = [words[i : i + 4] for i in range(0, 200, 4)]
    r.shuffle(phrases)
    scattered = [w for p in phrases for w in p]
    rows = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(scattered))]
    got = sorted(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0].near_next > 0.9 and got[1].near_next < 0.1


def test_query(spark, sf, docs):
    got = sorted(fingerprint.op7_syncmers(spark, sf).collect())
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == edited(docs)
    long = [r for r in got if r.n_chars > 300]
    assert min(r.near_edited for r in long) > 0.2 and sum(r.near_edited for r in long) / len(long) > 0.5
    texts = {}
    for r, (_, t) in zip(got, docs):
        assert texts.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and (r.near_next < 0.3 or t in [x for _, x in docs])


def test_ranges_meet(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rows = [(i * 3, f"text number {i} " * (1 + i % 5)) for i in range(100)]
    got = sorted(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == edited(rows)


def test_syncmers_are_those_of_the_definition(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i * i % 37}" for i in range(60))
    row = spark.createDataFrame([(text,)], "text string").select(fingerprint.unit_hashes(F.col("text")).alias("h")).select("h", fingerprint.positions(F.col("h")).alias("p")).first()
    h, k = row.h, fingerprint.K
    assert row.p == [i for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) == min(h[i : i + k])]


def test_positions_align(spark):
    a = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    b = spark.createDataFrame([(2, "new words first " + " ".join(f"w{i}" for i in range(10, 50)))], "doc_id long, text string")
    best = fingerprint.offsets(fingerprint.positioned(a), fingerprint.positioned(b)).orderBy("shared", ascending=False).first()
    assert best["shift"] == 3 - 10


def test_odd_rows(spark, odd):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r.n_chars == 0]
    assert {r.fingerprint for r in empty} == {""} and all(r.edited_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0
    one = fingerprint.fingerprints(odd.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_is_that_of_all_anchors(spark):
    one = " ".join(f"a{i}" for i in range(2000))
    two = one + " " + " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (2, two), (3, " ".join(f"a{i}" for i in range(900, 960)))]
    got = sorted(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    check(spark, rows, got)
    assert got[0].near_next > 0.9 and 0 < got[2].near_next < 0.1


def test_a_passage_whose_anchors_occur_earlier_too_aligns(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    table = lambda i, text: fingerprint.positioned(spark.createDataFrame([(i, text)], "doc_id long, text string"))
    shifts = {r["shift"]: r["shared"] for r in fingerprint.offsets(table(1, passage), table(2, f"{passage} between {passage}")).collect()}
    assert shifts[0] == shifts[51] > 10
