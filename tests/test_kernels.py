"""Hand examples and properties of the per-row perturbation kernels (pure Python)."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.functions import fixed, rng
from tremor.functions import kernels as K

ORIG_CM = fixed.codemix_lexicon(extended=False)
ORIG_SYN = fixed.synonym_lexicon(extended=False)
ORIG_VOW = fixed.vowel_sets(extended=False)


def perturber(extended=False):
    return K.Perturber(42, fixed.vowel_sets(extended), fixed.codemix_lexicon(extended),
                       fixed.synonym_lexicon(extended))


def test_codemix_hindi_ratio_one():
    assert K.codemix_words("मेरा घर बहुत अच्छा है।", 1.0, 7, ORIG_CM["hi"]) == "मेरा house बहुत good है।"


def test_codemix_marathi_ratio_one():
    assert K.codemix_words("हे पुस्तक खूप छान आहे.", 1.0, 7, ORIG_CM["mr"]) == "हे book खूप छान आहे."


def test_codemix_slash_and_lost_punctuation():
    assert K.codemix_words("जल्दी", 1.0, 1, ORIG_CM["hi"]) == "fast"
    assert K.codemix_words("घर।", 1.0, 1, ORIG_CM["hi"]) == "house"


def test_codemix_unknown_language_keeps_text_known_collapses():
    p = perturber()
    assert p.apply("two  spaces", "1", "en", "codemix", 1.0) == "two  spaces"
    assert p.apply("two  spaces", "1", "hi", "codemix", 1.0) == "two spaces"


def test_paraphrase_english_rate_one():
    out = K.paraphrase_words("This is a good test.", 1.0, 3, 4, ORIG_SYN["en"])
    words = out.split(" ")
    assert words[:3] == ["This", "is", "a"] and words[4] == "test."
    assert words[3] in ORIG_SYN["en"]["good"]


def test_paraphrase_no_slash_split_and_prefix_alias():
    p = perturber()
    out = p.apply("person", "9", "english", "paraphrase", 1.0)
    assert out in ORIG_SYN["en"]["person"]  # may be "man/woman", kept whole
    assert p.apply("good", "9", "unknown", "paraphrase", 1.0) == "good"


def test_vowel_drop_hindi_bangla_alias_unknown():
    p = perturber()
    assert p.apply("किताब", "1", "hi", "vowel_drop", 1.0) == "कतब"
    assert p.apply("ভালো", "1", "bangla", "vowel_drop", 1.0) == "ভল"
    assert p.apply("any text", "1", "xx", "vowel_drop", 1.0) == "any text"


def test_swap_and_delete_extremes():
    assert K.swap_chars("abcd", 1.0, 5) == "bcda"
    assert K.swap_chars("abcd", 0.0, 5) == "abcd"
    assert K.delete_chars("abcd", 1.0, 5) == ""
    assert K.delete_chars("abcd", 0.0, 5) == "abcd"


def test_empty_and_null_rules():
    p = perturber()
    for noise in ("char_delete", "char_swap", "vowel_drop"):
        assert p.apply("", "1", "en", noise, 0.5) == ""
        assert p.apply(None, "1", "en", noise, 0.5) == ""
    for word in ("codemix", "paraphrase"):
        assert p.apply("", "1", "hi", word, 0.5) == ""
        assert p.apply(None, "1", "hi", word, 0.5) is None
    assert p.apply(None, "1", "en", "clean", 0.5) is None


def test_long_text_no_overflow_and_rate():
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(50_000))
    out = K.delete_chars(text, 0.1, rng.py_row_key(42, "text:char_delete", "long"))
    n, kept = len(text), len(out)
    rate = (n - kept) / n
    assert abs(rate - 0.1) < 5 * (0.1 * 0.9 / n) ** 0.5


def _swap_loop(text, level, key):
    chars = list(text)
    draws = rng.np_draws(key, max(len(chars) - 1, 0))
    thr = rng.py_threshold(level)
    for i in range(len(chars) - 1):
        if draws[i] < thr:
            chars[i], chars[i + 1] = chars[i + 1], chars[i]
    return "".join(chars)


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=0, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]), st.integers(0, rng.P - 1))
def test_swap_closed_form_equals_sequential_loop(text, level, key):
    expect = "" if not text else (text if level <= 0 else _swap_loop(text, level, key))
    assert K.swap_chars(text, level, key) == expect


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.floats(0, 1), st.integers(0, rng.P - 1))
def test_delete_is_subsequence_and_swap_permutes(text, level, key):
    out = K.delete_chars(text, level, key)
    it = iter(text)
    assert all(c in it for c in out)
    assert sorted(K.swap_chars(text, level, key)) == sorted(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeiouxyzAE ", max_size=80), st.floats(0, 1), st.integers(0, rng.P - 1))
def test_vowel_drop_keeps_non_vowels_in_order(text, level, key):
    import numpy as np

    vowels = np.array(sorted({ord(c) for c in ORIG_VOW["en"]}), dtype=np.uint32)
    out = K.drop_vowels(text, level, key, vowels)
    strip = lambda s: "".join(c for c in s if c not in "aeiouAEIOU")
    assert strip(out) == strip(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="xyz \t 　", max_size=40))
def test_codemix_without_hit_collapses_whitespace(text):
    out = K.codemix_words(text, 1.0, 1, ORIG_CM["hi"])
    assert out == (" ".join(text.split()) if text else text)


def test_draws_are_uniform_enough():
    d = rng.np_draws(rng.py_row_key(42, "x", "y"), 200_000) / rng.P
    assert abs(d.mean() - 0.5) < 0.01
    assert abs((d < 0.1).mean() - 0.1) < 0.005


def test_stopword_stats():
    assert K.stopword_stats("The cat, of.", frozenset(fixed.RULE_STOPWORDS)) == (3, 2)
    assert K.stopword_stats("", frozenset(fixed.RULE_STOPWORDS)) == (1, 0)


def test_stop_words_are_counted_without_looking_at_every_token(monkeypatch):
    """Counts of many texts equal those of the tokens one by one, and no token is trimmed on its own."""
    rnd = random.Random(5)
    parts = [" ", " ", "the", "DIE", "a", "und", ".", ",", "é", "Σ", "İ", "\0", "x", "\n", "longerword"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(3000)] + ["", "...", "." * 50 + "the" + "," * 50 + " a", "the " * 90_000]
    words = frozenset(fixed.RULE_STOPWORDS)
    want = [(len(t.lower().split(" ")), sum(w.strip(".,") in words for w in t.lower().split(" "))) for t in texts]
    for some in (words, words | {"longerword"}, words | {""}):
        want_some = [(n, sum(w.strip(".,") in some for w in t.lower().split(" "))) for (n, _), t in zip(want, texts)]
        assert list(zip(*K.StopWords(some).counts(texts))) == want_some
    monkeypatch.setattr(K, "stopword_stats", None)
    assert list(zip(*K.StopWords(words).counts(texts))) == want and K.StopWords(words).counts([]) == ([], [])


def test_draws_at_places_and_vowels():
    k = rng.py_row_key(1, "op", "x")
    assert (rng.np_draws_at(k, np.array([0, 7, 30])) == rng.np_draws(k, 31)[[0, 7, 30]]).all()
    cps = np.array([ord(c) for c in "aeb\U0001f600xé"], np.uint32)
    assert K.members(cps, np.array([ord("a"), ord("é")], np.uint32)).tolist() == [True, False, False, False, False, True]
    assert not K.members(cps, np.array([], np.uint32)).any()
    text, shared = "banane und äpfel " * 20, K.Shared("banane und äpfel " * 20)
    vowels = np.array(sorted(map(ord, "aeuä")), np.uint32)
    for level in (0.2, 0.7, 1.0):
        drawn = rng.np_draws(k, len(text)) < rng.py_threshold(level)
        assert K.drop_vowels(text, level, k, vowels, shared) == "".join(c for c, d in zip(text, drawn) if not (d and c in "aeuä"))
