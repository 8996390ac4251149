"""Per-language unigram models over a fixed public vocabulary, summing over all segmentations of a word.

A word is split into vocabulary pieces in every possible way; its probability in a language is the sum over these ways of
the product of the pieces' probabilities, by a forward pass over the word's positions. As pieces never cross a word's
boundary, a text's probability is the product over its words, so each distinct word is scored once and looked up after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np

#: Marks a word's start in the vocabulary.
START = "▁"

#: Longer words are scored in stretches of so many characters, so that no word is too long for the arithmetic.
STRETCH = 40

#: Keeps forward sums near 1: about one over the probability of a character. A stretch of unknown ones stays above 1e-300.
_SCALE = 16.0

_UNKNOWN = 1e-7


@dataclass
class Lattice:
    """All pieces of the words, by end position: (word, start, piece, length) for each end."""

    words: list[str]
    lengths: np.ndarray
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def lattice(words: list[str], index: Mapping[str, int], longest: int) -> Lattice:
    """Pieces found in START + word. A character outside the vocabulary is piece -1."""
    ends: list[list[int]] = []
    lengths = np.zeros(len(words), dtype=np.int64)
    get = index.get
    for w, word in enumerate(words):
        text = START + word
        n = lengths[w] = len(text)
        while len(ends) < n:
            ends.append([])
        for s in range(n):
            for e in range(s + 1, min(n, s + longest) + 1):
                piece = get(text[s:e])
                if piece is not None:
                    ends[e - 1] += (w, s, piece, e - s)
                elif e == s + 1:
                    ends[s] += (w, s, -1, 1)
    return Lattice(words, lengths, [tuple(np.array(x, dtype=np.int64).reshape(-1, 4).T) for x in ends])


def _edge_probability(table: np.ndarray, piece: np.ndarray, length: np.ndarray) -> np.ndarray:
    p = table[piece] * (_SCALE ** length)[:, None]
    p[piece < 0] = _UNKNOWN * _SCALE
    return p


def forward(lat: Lattice, table: np.ndarray) -> list[np.ndarray]:
    """Forward sums at every position 0..n, each (words, languages); table: (pieces, languages)."""
    count, langs = len(lat.words), table.shape[1]
    sums = [np.ones((count, langs))]
    for w, s, piece, length in lat.ends:
        here = np.zeros((count, langs))
        if len(w):
            by_start = np.stack(sums)[s, w] if len(sums) <= 64 else np.array([sums[a][b] for a, b in zip(s, w)])
            np.add.at(here, w, by_start * _edge_probability(table, piece, length))
        sums.append(here)
    return sums


def _stretches(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Each word in stretches of at most STRETCH characters, and the word that each stretch is of."""
    parts, owner = [], []
    for i, word in enumerate(words):
        for at in range(0, max(1, len(word)), STRETCH):
            parts.append(word[at : at + STRETCH])
            owner.append(i)
    return parts, np.array(owner, dtype=np.int64)


def word_log_probabilities(words: list[str], index: Mapping[str, int], longest: int, table: np.ndarray) -> np.ndarray:
    """(words, languages) natural logarithms of the words' probabilities, all segmentations summed."""
    parts, owner = _stretches(words)
    out = np.zeros((len(words), table.shape[1]))
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        lat = lattice([parts[i] for i in some], index, longest)
        sums = np.stack(forward(lat, table))
        ended = sums[lat.lengths, np.arange(len(some))]
        logs = np.log(np.maximum(ended, 1e-300)) - (lat.lengths * np.log(_SCALE))[:, None]
        np.add.at(out, owner[some], logs)
    return out


def expected_pieces(words: list[str], weights: np.ndarray, index: Mapping[str, int], longest: int, table: np.ndarray, grid: float | None = None) -> np.ndarray:
    """Expected piece counts (pieces, languages) given word counts (words, languages): one step of expectation.

    grid: what a word adds is rounded to multiples of it, so that sums don't depend on the order of the words.
    """
    counts = np.zeros_like(table)
    words, owner = _stretches(words)
    weights = weights[owner]
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        lat = lattice([words[i] for i in some], index, longest)
        sums = forward(lat, table)
        behind = [np.zeros_like(sums[0]) for _ in sums]
        rows = np.arange(len(some))
        for i, n in enumerate(lat.lengths):
            behind[n][i] = 1.0
        total = np.stack(sums)[lat.lengths, rows]
        share = weights[some] / np.maximum(total, 1e-300)
        for end in range(len(lat.ends), 0, -1):
            w, s, piece, length = lat.ends[end - 1]
            if not len(w):
                continue
            p = _edge_probability(table, piece, length)
            after = behind[end][w]
            before = np.stack(sums)[s, w]
            known = piece >= 0
            added = (before * p * after * share[w])[known]
            np.add.at(counts, piece[known], np.rint(added / grid) * grid if grid else added)
            for start in np.unique(s):
                at_start = s == start
                np.add.at(behind[start], w[at_start], (p * after)[at_start])
    return counts


@dataclass
class PieceModel:
    """Piece probabilities of each language, and the words scored so far in this process."""

    langs: list[str]
    pieces: list[str]
    table: np.ndarray
    #: Share of a word's probability that any language could have produced; bounds what one word can say against a language.
    blur: float = 0.01
    most_words: int = 400_000
    _index: dict[str, int] = field(default_factory=dict, repr=False)
    _ids: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._index = {p: i for i, p in enumerate(self.pieces)}
        self._longest = max(map(len, self.pieces), default=1)
        self._forget()

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "pieces": self.pieces, "table": self.table.astype(np.float32), "blur": self.blur, "most_words": self.most_words}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.table = self.table.astype(np.float64)
        self._ids = {}
        self.__post_init__()

    def _forget(self) -> None:
        self._ids.clear()
        self._relative = np.zeros((1024, len(self.langs)), dtype=np.float32)
        self._plain = np.zeros(1024)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row of each word in relative() and plain(); new words are scored first."""
        if len(self._ids) > self.most_words:
            self._forget()
        known = self._ids
        new = list({w for w in words if w not in known})
        if new:
            self._add(new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def _add(self, new: list[str]) -> None:
        logs = word_log_probabilities(new, self._index, self._longest, self.table)
        top = logs.max(axis=1, keepdims=True)
        mean = top + np.log(np.exp(logs - top).mean(axis=1, keepdims=True))
        relative = np.log((1 - self.blur) * np.exp(logs - mean) + self.blur)
        at = len(self._ids)
        while at + len(new) > len(self._relative):
            self._relative = np.concatenate([self._relative, np.zeros_like(self._relative)])
            self._plain = np.concatenate([self._plain, np.zeros_like(self._plain)])
        self._relative[at : at + len(new)] = relative
        self._plain[at : at + len(new)] = top[:, 0]
        self._ids.update(zip(new, range(at, at + len(new))))

    def relative(self) -> np.ndarray:
        """(words, languages): log of how much likelier a word is in a language than in the mean of all."""
        return self._relative

    def plain(self) -> np.ndarray:
        """(words,): log probability in the likeliest language."""
        return self._plain


def fit(langs: list[str], pieces: list[str], counts: Mapping[str, Mapping[str, float]], rounds: int = 4, weight: float = 30.0) -> PieceModel:
    """Piece probabilities by expectation and maximisation from word counts {language: {word: count}}.

    weight: so many pieces of every language are taken from the mean of all, so that no piece is impossible in one.
    """
    index = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    words = sorted({w for c in counts.values() for w in c})
    of = {w: i for i, w in enumerate(words)}
    seen = np.zeros((len(words), len(langs)))
    for k, lang in enumerate(langs):
        for w, n in counts.get(lang, {}).items():
            seen[of[w], k] = n
    return maximised(langs, pieces, lambda table: expected_pieces(words, seen, index, longest, table), rounds, weight)


def maximised(langs: list[str], pieces: list[str], expected: Callable[[np.ndarray], np.ndarray], rounds: int = 4, weight: float = 30.0) -> PieceModel:
    """The rounds of fit; expected: a table's expected piece counts, wherever the words are."""
    table = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds):
        found = expected(table)
        per = found / np.maximum(found.sum(axis=0), 1e-9)
        mean = 0.9 * per.mean(axis=1, keepdims=True) + 0.1 / len(pieces)
        table = (found + weight * mean) / (found.sum(axis=0) + weight)
    return PieceModel(langs, pieces, table)


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that occur in lower-case words, by a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every: Iterable[int] = range(model.get_piece_size())
    kept = (i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in map(model.id_to_piece, kept) if p == p.lower()})
