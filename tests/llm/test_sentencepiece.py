"""Long words of every kind against the library."""

import random
import time

import pytest

from graphloom.llm import sentencepiece_codec

rnd = random.Random(9)


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sentencepiece_codec.codec(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())


def ids(codec, t):
    return codec.encode([t])[0].tolist()


def test_long_words_equal_the_library(both):
    codec, library = both
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = ["x" * 5000, "ab" * 4000, " " * 5000 + "a", "=" * 3000, "abc" * 1700, "日本語" * 1500, "e" * 1025, "the" * 1000 + "日" * 10 + "re" * 2000]
    some += ["".join(rnd.choice(letters) for _ in range(n)) for n in (1024, 1025, 1281, 2000, 6000)]
    some += ["".join(rnd.choice("théßñ日本한🙂'-_0123456789<>") for _ in range(n)) for n in (1500, 5000)]
    some += ["".join(rnd.choice(["the", "ing", "tion", "ation", "er"]) for _ in range(2500))]
    for t in some:
        assert ids(codec, t) == library.encode(t), t[:30]


def test_a_megabyte_without_spaces(both):
    codec, library = both
    t = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    at = time.time()
    got = ids(codec, t)
    assert time.time() - at < 90
    assert got == library.encode(t)


def test_place_by_place_equals_slices(both, monkeypatch):
    codec, library = both
    # Slices of a length that no period divides, and an overlap too short to agree.
    monkeypatch.setattr(sentencepiece_codec, "SLICE", 61)
    monkeypatch.setattr(sentencepiece_codec, "LAP", 20)
    for t in ("x" * 700, "ab" * 300, "".join(rnd.choice("etaoin") for _ in range(900))):
        codec.known.clear()
        assert ids(codec, t) == library.encode(t)
    codec.known.clear()


def test_unigram_slices_equal_brute_force(monkeypatch):
    pieces = [("", -1e9)] + [(p, -0.3 * len(p) - 0.1 * k) for k, p in enumerate(["▁", "a", "b", "ab", "ba", "aba", "▁a", "bb"])]
    c = sentencepiece_codec.Codec(pieces, [], True)
    monkeypatch.setattr(sentencepiece_codec, "SLICE", 40)
    monkeypatch.setattr(sentencepiece_codec, "LAP", 12)
    for _ in range(20):
        t = "▁" + "".join(rnd.choice("ab") for _ in range(rnd.randint(60, 300)))
        best = [0.0] + [-1e18] * len(t)
        for i in range(1, len(t) + 1):
            best[i] = max((best[i - k] + c.score[c.id_of[t[i - k : i]]] for k in range(1, min(i, c.longest) + 1) if t[i - k : i] in c.id_of), default=-1e18)
        assert sum(c.score[i] for i in c.encode([t[1:]])[0]) == pytest.approx(best[-1])
