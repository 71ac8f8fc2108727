import numpy as np

from readloom.llm import langid, wordhash
from readloom.llm.wordhash import Words
from tests.llm import brute


def test_words_are_the_same_in_pieces_of_any_size(monkeypatch):
    texts = ["One  two\tthree " * 50, "", "x" * 300 + " yé", " \n", "One two"]
    whole = Words(texts, True)
    assert np.diff(whole.first).tolist() == [len(brute.words(t)) for t in texts]
    assert [whole.buffer[a:b].decode() for a, b in zip(whole.start, whole.end)] == [w for t in texts for w in brute.words(t)]
    same = {}
    for t, h in zip([w for t in texts for w in brute.words(t, lower=True)], whole.hash.tolist()):
        assert same.setdefault(t, h) == h
    assert len(set(same.values())) == len(same)
    for piece in (1, 7, 64):
        monkeypatch.setattr(wordhash, "PIECE", piece)
        small = Words(texts, True)
        for a in ("start", "end", "hash", "first"):
            assert getattr(small, a).tolist() == getattr(whole, a).tolist()


def test_a_long_text_is_one_text(monkeypatch):
    counts = np.zeros((2, langid.CELLS))
    for i, t in enumerate(["the cat and the dog ", "der hund und die katze "]):
        counts[i] = np.bincount(langid.features([t * 20])[0], minlength=langid.CELLS)
    model = langid.Mixture(["en", "de"], counts)
    text = "the cat and the dog " * 200 + "der hund und die katze " * 100
    whole = model.predict([text])[0]
    monkeypatch.setattr(langid, "BLOCK", 500)
    parts = model.predict([text])[0]
    assert whole[0] == parts[0] == "en" and abs(whole[1] - parts[1]) < 0.02 and set(parts[2]) == {"en", "de"}
