"""Per-row perturbation helpers, run inside Arrow batches (see tremor.operators.perturb).

Text is handled as a numpy array of Unicode code points, so every character operation is
vectorized; only the word-level lexicon operations loop over tokens.  All randomness comes
from tremor.functions.rng (position-indexed, partition independent).
"""

from __future__ import annotations

import unicodedata
from itertools import repeat

import numpy as np

from tremor.functions import fixed, rng

NOISE_STEPS = ("char_delete", "char_swap", "vowel_drop")
WORD_STEPS = ("codemix", "paraphrase")
STEP_ALIASES = {"delete": "char_delete", "swap": "char_swap"}


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _text(cps: np.ndarray) -> str:
    return np.ascontiguousarray(cps, dtype=np.uint32).tobytes().decode("utf-32-le")


class Shared:
    """What several grid rows of one text have in common: its code points, its words and the draws of a key."""

    def __init__(self, text: str):
        self.text = text
        self._cps = self._words = None
        self._draws: dict = {}
        self._draws_at: dict = {}

    def cps(self) -> np.ndarray:
        if self._cps is None:
            self._cps = _codepoints(self.text)
        return self._cps

    def words(self) -> list[str]:
        if self._words is None:
            self._words = self.text.split()
        return self._words

    def draws(self, key: int, n: int) -> np.ndarray:
        """Draws of positions 0 to n - 1 (a draw depends on key and position alone)."""
        have = self._draws.get(key)
        if have is None or len(have) < n:
            have = self._draws[key] = rng.np_draws(key, n)
        return have[:n]

    def draws_at(self, key: int, places) -> tuple[np.ndarray, np.ndarray]:
        """The places that `places()` gives (the same for every use of a key) and their draws."""
        have = self._draws_at.get(key)
        if have is None:
            at = places()
            have = self._draws_at[key] = (at, rng.np_draws_at(key, at))
        return have


def delete_chars(text, level: float, key: int, shared: Shared | None = None) -> str:
    """Drop each code point with probability `level`."""
    if not text:
        return ""
    if level <= 0:
        return text
    shared = shared or Shared(text)
    cps = shared.cps()
    keep = shared.draws(key, len(cps)) >= rng.py_threshold(level)
    return _text(cps[keep])


def swap_chars(text, level: float, key: int, shared: Shared | None = None) -> str:
    """Left-to-right adjacent swaps (position i with i+1 with probability `level`).

    Closed form of the sequential loop: cut after every position that does not swap and
    rotate each segment left by one, i.e. out[i] = c[i+1] if i swaps, else the first
    character of i's segment.
    """
    if not text:
        return ""
    if level <= 0:
        return text
    shared = shared or Shared(text)
    cps = shared.cps()
    n = len(cps)
    if n < 2:
        return text
    swaps = np.zeros(n, dtype=bool)
    swaps[: n - 1] = shared.draws(key, n - 1) < rng.py_threshold(level)
    idx = np.arange(n, dtype=np.int64)
    stops = np.where(~swaps, idx, -1)
    prev_stop = np.empty(n, dtype=np.int64)
    prev_stop[0] = -1
    prev_stop[1:] = np.maximum.accumulate(stops[:-1])
    src = np.where(swaps, idx + 1, prev_stop + 1)
    return _text(cps[src])


def members(cps: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which code points are among the (few) wanted ones, by a table up to the largest of these."""
    table = np.zeros(int(wanted.max(initial=0)) + 2, bool)
    table[wanted] = True
    return table[np.minimum(cps, len(table) - 1)]


def drop_vowels(text, level: float, key: int, vowels: np.ndarray | None, shared: Shared | None = None) -> str:
    """Drop code points of the language's vowel set with probability `level`; unknown language: unchanged."""
    if not text:
        return ""
    if level <= 0 or vowels is None:
        return text
    shared = shared or Shared(text)
    cps = shared.cps()
    places, draws = shared.draws_at(key, lambda: np.flatnonzero(members(cps, vowels)))
    return _text(np.delete(cps, places[draws < rng.py_threshold(level)]))


def _looked_up(words: list[str], drawn: np.ndarray, strip: str, table: dict):
    """(place, table entry or None) of every drawn word."""
    at = np.flatnonzero(drawn).tolist()
    return zip(at, map(table.get, map(str.strip, map(words.__getitem__, at), repeat(strip))), strict=True)


def codemix_words(text, ratio: float, key: int, vocab: dict | None, shared: Shared | None = None) -> str:
    """Replace lexicon words (punctuation-stripped, case-sensitive) by the first '/'-alternative.

    Tokens come from a whitespace split and are re-joined by single spaces, so whitespace collapses and the
    punctuation of a replaced word is lost, exactly as in the original.
    """
    if not text or vocab is None:
        return text
    shared = shared or Shared(text)
    words = shared.words()
    if not words:
        return ""
    out = words.copy()
    for i, repl in _looked_up(words, shared.draws(key, len(words)) < rng.py_threshold(ratio), fixed.CODEMIX_STRIP, vocab):
        if repl is not None:
            out[i] = repl.split("/")[0]
    return " ".join(out)


def paraphrase_words(text, rate: float, key: int, pick_key: int, synonyms: dict | None, shared: Shared | None = None) -> str:
    """Replace lexicon words by a uniformly chosen synonym (choice = second draw mod #synonyms)."""
    if not text or synonyms is None:
        return text
    shared = shared or Shared(text)
    words = shared.words()
    if not words:
        return ""
    out, picks = words.copy(), None
    for i, syns in _looked_up(words, shared.draws(key, len(words)) < rng.py_threshold(rate), fixed.PARAPHRASE_STRIP, synonyms):
        if syns is not None:
            picks = shared.draws(pick_key, len(words)) if picks is None else picks
            out[i] = syns[int(picks[i]) % len(syns)]
    return " ".join(out)


def steps_of(perturbation: str) -> list[str]:
    """'char_delete+char_swap' -> ['char_delete', 'char_swap']; 'clean' -> []."""
    if perturbation is None or perturbation == "clean":
        return []
    return [STEP_ALIASES.get(s, s) for s in perturbation.split("+")]


class Perturber:
    """Applies a (possibly chained) perturbation to one text; lexicons are small, bounded parameters."""

    def __init__(self, seed, vowels: dict, codemix: dict, synonyms: dict, strict: bool = True):
        self.seed = seed
        self.vowels = {k: np.array(sorted({ord(c) for c in v}), dtype=np.uint32) for k, v in vowels.items()}
        self.codemix = codemix
        self.synonyms = synonyms
        self.strict = strict

    def vowel_key(self, lang):
        if lang is None:
            return None
        lo = lang.lower()
        if lo in self.vowels:
            return lo
        return fixed.VOWEL_ALIASES.get(lo)

    def synonym_key(self, lang):
        if lang is None:
            return None
        lo = lang.lower()
        if lo not in self.synonyms:
            for p in fixed.PARAPHRASE_PREFIXES:
                if lo.startswith(p):
                    return p
        return lo

    def apply(self, text, row_id, lang, perturbation, level, side="text", shared: Shared | None = None):
        """`shared` belongs to the given text; the steps behind the first of a chain work on other texts."""
        for step in steps_of(perturbation):
            op = f"{side}:{step}"
            key = rng.py_row_key(self.seed, op, row_id)
            if step == "char_delete":
                text = delete_chars(text, level, key, shared)
            elif step == "char_swap":
                text = swap_chars(text, level, key, shared)
            elif step == "vowel_drop":
                vk = self.vowel_key(lang)
                text = drop_vowels(text, level, key, self.vowels.get(vk) if vk else None, shared)
            elif step == "codemix":
                text = codemix_words(text, level, key, self.codemix.get(lang.lower()) if lang else None, shared)
            elif step == "paraphrase":
                pick = rng.py_row_key(self.seed, op + ".pick", row_id)
                text = paraphrase_words(text, level, key, pick, self.synonyms.get(self.synonym_key(lang)), shared)
            elif self.strict:
                raise ValueError(f"unknown perturbation step {step!r}")
            shared = None
        return text

    def variants(self, text, row_id, lang, grid, side="text") -> list:
        """The text under every (perturbation, level) of `grid`; code points, words and draws are shared."""
        if text is None:
            return [None] * len(grid)
        shared = Shared(text)
        return [self.apply(text, row_id, lang, p, lv, side, shared) for p, lv in grid]


def stopword_stats(text, words: frozenset, strip: str = fixed.RULE_TOKEN_STRIP) -> tuple[int, int]:
    """(tokens, stop-word hits) of the rule model: lower-cased, split on single spaces, `strip` trimmed.

    Trimming is done on the whole text, by taking `strip` characters off the spaces beside them, so that a token
    costs one look-up; a text with long runs of such characters is trimmed token by token instead.
    """
    t = (text or "").lower().strip(strip)
    pairs = [p for c in strip for p in ((c + " ", " "), (" " + c, " "))]
    for _ in range(4):
        todo = [p for p in pairs if p[0] in t]
        if not todo:
            tokens = t.split(" ")
            return len(tokens), sum(map(words.__contains__, tokens))
        for edge, plain in todo:
            t = t.replace(edge, plain)
    tokens = t.split(" ")
    return len(tokens), sum(w.strip(strip) in words for w in tokens)


#: Bytes of text whose tokens are counted at once (they stay in a core's cache).
COUNT_BYTES = 1 << 18
#: Steps in which characters are trimmed off all tokens together; tokens with more of them are trimmed one by one.
TRIM_STEPS = 16


class StopWords:
    """`stopword_stats` of many texts: tokens are found, trimmed and compared as numbers of up to eight bytes.

    Words that do not fit (longer, empty, with a space or a trimmed character at an edge) are left to `stopword_stats`.
    """

    def __init__(self, words, strip: str = fixed.RULE_TOKEN_STRIP):
        self.words, self.strip = frozenset(words), strip
        coded = sorted((int.from_bytes(w.encode(), "little"), len(w.encode())) for w in self.words if 0 < len(w.encode()) <= 8)
        self.fits = len(coded) == len(self.words) > 0 and strip.isascii() and " " not in strip and not any(" " in w or "\0" in w for w in self.words)
        self.keys, self.lens = np.array([c[0] for c in coded], np.uint64), np.array([c[1] for c in coded], np.int64)
        self.trimmed = np.zeros(256, bool)
        self.trimmed[list(strip.encode())] = True
        self.masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and stop-word hits of every text."""
        if not self.fits:
            got = [stopword_stats(t, self.words, self.strip) for t in texts]
            return [g[0] for g in got], [g[1] for g in got]
        tokens, hits, part, size = [], [], [], 0
        for t in texts:
            part.append((t or "").lower().encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            if size >= COUNT_BYTES:
                self._count(part, tokens, hits)
                part, size = [], 0
        if part:
            self._count(part, tokens, hits)
        return tokens, hits

    def _count(self, texts: list[bytes], tokens: list[int], hits: list[int]) -> None:
        raw = b" " + b" ".join(texts) + b" " * 9
        b = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(b[:-8] == 32)
        starts, ends = spaces[:-1] + 1, spaces[1:].copy()
        for at, edge, step in ((starts, 0, 1), (ends, -1, -1)):
            open_ = np.flatnonzero(self.trimmed[b[at + edge]] & (starts < ends))
            for _ in range(TRIM_STEPS):
                at[open_] += step
                open_ = open_[self.trimmed[b[at[open_] + edge]] & (starts[open_] < ends[open_])]
                if not len(open_):
                    break
            for i in open_.tolist():
                token = raw[starts[i]:ends[i]]
                at[i] += step * (len(token) - len(token.lstrip(self.strip.encode()) if step > 0 else token.rstrip(self.strip.encode())))
        lens = ends - starts
        short = np.flatnonzero((lens > 0) & (lens <= self.lens.max()))
        lens = lens[short]
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        values = eight[starts[short]] & self.masks[lens]
        near = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        found = short[(self.keys[near] == values) & (self.lens[near] == lens)]
        n = [t.count(b" ") + 1 for t in texts]
        tokens += n
        hits += np.bincount(np.repeat(np.arange(len(n)), n)[found], minlength=len(n)).tolist()


def join_fields(premise, hypothesis, text) -> str:
    """Model input: the present fields joined by one space (as concat_ws)."""
    return " ".join(x for x in (premise, hypothesis, text) if x is not None)


def normalized(text) -> str:
    """As `functions.text.normalize`: null -> '', NFKC, U+FFFD dropped, whitespace runs to one space, stripped."""
    if not text:
        return ""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.replace("\ufffd", "").split())
