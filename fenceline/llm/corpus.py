"""What the languages' fit needs of all documents: lines as codes, parsed once, and counts of words added up by Spark.

A block holds some documents; its words are listed once and lines are arrays of positions in that list. Sums are of whole
numbers or of multiples of a power of two, so they don't depend on how documents and words are spread over tasks.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cues import _ADDRESS, _COLOURED, _MARKUP, _SOUND, _SOUND_SIGNS, TIME_LINE, cues_of, looks_misread, spoken
from .pieces import PieceModel, expected_pieces, maximised

if TYPE_CHECKING:
    from .languages import Labeller

#: Documents and characters of a block, whichever is reached first; bounds memory.
BLOCK_DOCS, BLOCK_CHARS = 256, 2_000_000

#: Expected piece counts are added up in multiples of this: exact to 5e8 of a piece.
GRID = 2.0**-24

#: A word as words_of has it, or a number, or a line's end.
_TOKEN = re.compile(r"[^\W_]+|\n")

#: Every line with an address has one of these.
_ADDRESS_SIGN = re.compile(r"\.[a-z][a-z]|www\.|https?:")


@lru_cache(100_000)
def word_key(word: str) -> int:
    """64 bits that stand for a word wherever the words of all documents are held together."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Lines:
    """Lines of words: positions of their words in the block's list, line after line, and the words in each."""

    codes: np.ndarray
    sizes: np.ndarray

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def once(self, n_words: int) -> Lines:
        """Each word once a line."""
        both = np.sort(np.repeat(np.arange(len(self.sizes)), self.sizes) * n_words + self.codes)
        line, codes = np.divmod(both[np.diff(both, prepend=-1) > 0], max(1, n_words))
        return Lines(codes, np.bincount(line, minlength=len(self.sizes)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each line, the sum of its words' rows of values; no line is without words."""
        return np.add.reduceat(values[self.codes], self.starts(), axis=0) if len(self.sizes) else np.zeros((0, *values.shape[1:]))

    def counts(self, times: np.ndarray, n_words: int) -> np.ndarray:
        """How often each of n_words words is in the lines, each of which counts so many times."""
        some = self.of(times > 0)
        return np.bincount(some.codes, np.repeat(times[times > 0], some.sizes), minlength=n_words).astype(np.int64)

    def of(self, kept: np.ndarray) -> Lines:
        return Lines(self.codes[np.repeat(kept, self.sizes)], self.sizes[kept])


def coded(lines: list[str]) -> tuple[list[str], Lines]:
    """words_of all the lines: the words, each once, and every line as positions in them."""
    at: dict[str, int] = defaultdict(itertools.count().__next__)
    at["\n"]  # 0 ends a line
    codes, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(lines), 16384):  # bounds memory
        some = lines[i : i + 16384]
        found = _TOKEN.findall("\n".join(some).lower())
        token = np.fromiter(map(at.__getitem__, found), dtype=np.int64, count=len(found))
        word = np.array([not w.isdigit() for w in at])
        word[0] = False
        kept = word[token]
        codes.append(token[kept])
        sizes.append(np.bincount(np.cumsum(token == 0)[kept], minlength=len(some)))
    word = np.array([not w.isdigit() for w in at])
    word[0] = False
    return [w for w, x in zip(at, word) if x], Lines((np.cumsum(word) - 1)[np.concatenate(codes)], np.concatenate(sizes))


@dataclass
class Block:
    words: list[str]
    keys: np.ndarray
    #: The lines with words that the block holds, and the same with each word once.
    lines: Lines
    once: Lines
    #: Lines that could be notices, by their place in lines, and whether they surely are.
    shown: np.ndarray
    sure: np.ndarray
    #: Lines of dialogue cues before notices are known, with their document and cue.
    said: np.ndarray
    doc: np.ndarray
    cue: np.ndarray
    #: Texts in a wrong encoding, with their document: how they are read depends on the model.
    misread: list[tuple[int, str]]

    def dialogue(self, notices: KeyedNotices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines of dialogue cues that are no notices, with their document and cue."""
        kept = ~notices.lines(self.once, self.keys)[self.said]
        return self.said[kept], self.doc[kept], self.cue[kept]


def _block(lines: list[str], shown: np.ndarray, sure: np.ndarray, said: np.ndarray, doc: np.ndarray, cue: np.ndarray, misread: list[tuple[int, str]]) -> Block:
    """shown, said: places in lines, which may have no words, too."""
    words, every = coded(lines)
    some = every.sizes > 0
    place = np.cumsum(some) - 1
    kept, spoke = some[shown], some[said]
    lines_in = every.of(some)
    keys = np.array([word_key(w) for w in words], dtype=np.int64)
    return Block(words, keys, lines_in, lines_in.once(len(words)), place[shown[kept]], sure[kept], place[said[spoke]], doc[spoke], cue[spoke], misread)


def block_of(texts: Iterable[str | None], learning: bool = True) -> Block:
    """The same as notice_lines, cues_of and spoken give of each text, but every different line is looked at once.

    learning: with the lines that notices are learnt from.
    """
    at: dict[str, int] = defaultdict(itertools.count().__next__)
    placed, sizes, docs, wrong, misread, untimed = [], [], [], [], [], {}
    for d, text in enumerate(texts):
        if not text:
            continue
        if bad := looks_misread(text):
            misread.append((d, text))
            if not learning:
                continue
        raw = (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text).split("\n")
        placed.extend(map(at.__getitem__, raw))
        sizes.append(len(raw))
        docs.append(d)
        wrong.append(bad)
        if not bad:
            untimed[len(docs) - 1] = text  # until a time line is found
    # no markup goes over a line's end, so it can be removed from each line alone
    raw = list(at)
    bare = [_MARKUP.sub("", x) if "<" in x or "{" in x else x for x in raw]
    timed, timed_raw, blank, signs, dotted, address, colour = (np.zeros(len(raw), dtype=bool) for _ in range(7))
    timed[[i for i, x in enumerate(bare) if "->" in x and TIME_LINE.match(x)]] = True
    timed_raw[[i for i in np.flatnonzero(timed).tolist() if bare[i] is raw[i] or TIME_LINE.match(raw[i])]] = True
    rest = np.flatnonzero(~timed_raw)
    text_of = [bare[i] for i in rest.tolist()]
    blank[rest[[not x or x.isspace() for x in text_of]]] = True
    dotted[rest[["." in x for x in text_of]]] = True
    whole, ends = "\n".join(text_of), np.cumsum([len(x) + 1 for x in text_of])

    def with_any(sign: re.Pattern) -> np.ndarray:
        return rest[np.unique(np.searchsorted(ends, [m.start() for m in sign.finditer(whole)], side="right"))]

    signs[with_any(_SOUND_SIGNS)] = True
    address[[i for i in with_any(_ADDRESS_SIGN).tolist() if _ADDRESS.search(bare[i])]] = True
    colour[[i for i, x in enumerate(raw) if "<" in x and _COLOURED.search(x)]] = True
    lines = [""] * len(raw)
    for i, x in zip(rest.tolist(), text_of):
        lines[i] = x
    for i in np.flatnonzero(signs).tolist():
        lines[i] = _SOUND.sub(" ", bare[i])

    of = np.array(placed, dtype=np.int64)
    nth = np.repeat(np.arange(len(docs)), np.array(sizes, dtype=np.int64))
    first = np.cumsum([0, *sizes])[:-1].astype(np.int64)

    def numbered(time: np.ndarray) -> np.ndarray:
        """How many time lines of its document each line follows; -1 on these lines."""
        count = np.cumsum(time[of])
        return np.where(time[of], -1, count - (count[first] - time[of[first]])[nth]) if len(of) else count

    shown = of[numbered(timed_raw) > 0] if learning else of[:0]
    cue = numbered(timed)
    spoke = np.flatnonzero((cue > 0) & ~np.array(wrong, dtype=bool)[nth] & ~blank[of]) if len(of) else of
    # what spoken does with a cue, for cues without signs of sounds
    start = np.flatnonzero(np.diff(nth[spoke], prepend=-1) | np.diff(cue[spoke], prepend=-1))
    cue_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(spoke))))
    any_of = lambda flag: np.logical_or.reduceat(flag[of[spoke]], start) if len(start) else np.zeros(0, dtype=bool)
    loud = any_of(signs)
    plain = ~loud[cue_of] & ~(any_of(dotted)[cue_of] & address[of[spoke]])
    at_place, said = [spoke[plain]], [of[spoke[plain]]]
    more: list[tuple[int, int, list[str]]] = []
    ends = np.append(start, len(spoke))
    for c in np.flatnonzero(loud):
        here = spoke[ends[c] : ends[c + 1]]
        heard = [x for x in (bare[i].strip() for i in of[here]) if not x.isdigit()]
        more.append((int(here[0]), int(cue[here[0]]), spoken(heard)))
    with_time = set(nth[np.flatnonzero(timed[of])].tolist()) if len(of) else set()
    for n, text in untimed.items():
        if n not in with_time:  # cues and lines are told apart otherwise there
            more += [(int(first[n]), number, spoken(x)) for number, x in enumerate(cues_of(text), 1) if x]
    extra = [(place, number, x) for place, number, some in more for x in some]
    place = np.concatenate([*at_place, np.array([p for p, _, _ in extra], dtype=np.int64)])
    order = np.argsort(place, kind="stable")
    said_all = np.concatenate([*said, len(lines) + np.arange(len(extra))])[order]
    number = np.concatenate([cue[spoke[plain]], np.array([n for _, n, _ in extra], dtype=np.int64)])[order]
    doc = np.array(docs, dtype=np.int64)[nth[place[order]]]
    return _block([*lines, *(x for _, _, x in extra)], shown, (address | colour)[shown], said_all, doc, number, misread)


def block_of_cues(cues: Iterable[tuple[int, int, list[str]]]) -> Block:
    """cues: (document, number, lines as cues_of gives them)."""
    said = [(d, number, x) for d, number, lines in cues for x in spoken(lines)]
    doc, cue = (np.array([x[i] for x in said], dtype=np.int64) for i in (0, 1))
    return _block([x for _, _, x in said], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.arange(len(said)), doc, cue, [])


def _packed(block: Block) -> bytes:
    small = lambda x: x.astype(np.min_scalar_type(x.max(initial=0)))
    numbers = [small(x) for x in (block.lines.codes, block.lines.sizes, block.shown, block.said, block.doc, block.cue)]
    return pickle.dumps((block.words, block.keys, numbers, block.sure, block.misread), protocol=5)


def unpacked(data: bytes) -> Block:
    words, keys, numbers, sure, misread = pickle.loads(data)
    codes, sizes, shown, said, doc, cue = (x.astype(np.int64) for x in numbers)
    lines = Lines(codes, sizes)
    return Block(words, keys, lines, lines.once(len(words)), shown, sure, said, doc, cue, misread)


def blocks(docs: DataFrame, *names: str) -> DataFrame:
    """(block, *names): all documents, each read whole, with these columns of a block's documents as arrays."""
    rows = docs.select("text", *names)

    def one(texts: list[str | None], named: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([x.column(i) for x in named]) for i in range(1, 1 + len(names))]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array([_packed(block_of(texts))], pa.binary()), *arrays], ["block", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str | None] = []
        named: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(0)):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if len(texts) >= BLOCK_DOCS or size >= BLOCK_CHARS:
                    yield one(texts, [*named, batch.slice(at, i + 1 - at)])
                    texts, named, size, at = [], [], 0, i + 1
            if at < batch.num_rows:
                named.append(batch.slice(at))
        if texts:
            yield one(texts, named)

    return rows.mapInArrow(run, ", ".join(["block binary", *(f"`{x}` array<{rows.schema[x].dataType.simpleString()}>" for x in names)]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    return (unpacked(data.as_py()) for batch in batches for data in batch.column(0))


@dataclass
class KeyedNotices:
    """Notices (cues.py) of any number of words: sorted keys of the words with their weights, in place of the words."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    least: float = math.inf
    most_words: int = 400_000
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """The weight of each key; 0 for words that weren't seen."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)

    def holds(self, words: list[str]) -> bool:
        if self.least == math.inf:
            return False
        known = self._known
        if len(known) > self.most_words:
            known.clear()
        if new := [w for w in words if w not in known]:
            known.update(zip(new, self.weights(np.array([word_key(w) for w in new], dtype=np.int64)).tolist()))
        return sum(map(known.__getitem__, set(words))) > self.least

    def lines(self, once: Lines, keys: np.ndarray) -> np.ndarray:
        """Whether each line, of words that are listed by key, is a notice."""
        return once.sums(self.weights(keys)) > self.least


def _key_counts(parsed: DataFrame, counted: Callable[[Block], list[np.ndarray]], names: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """(keys, lines with each key, lines) over all blocks; counted: masks of a block's shown lines, one for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches):
            masks = counted(block)
            each = [block.once.counts(np.bincount(block.shown[m], minlength=len(block.once.sizes)), len(block.keys)) for m in masks]
            some = np.flatnonzero(np.any(each, axis=0))
            keys = pa.array([None, *block.keys[some].tolist()], pa.int64())  # the null key counts the lines
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.append(m.sum(), n[some]), pa.int64()) for m, n in zip(masks, each))], ["key", *names])

    rows = parsed.mapInArrow(run, ", ".join(f"{x} long" for x in ["key", *names]))
    sums = rows.groupBy("key").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    keys = sums["key"].combine_chunks()
    lines = keys.is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(found := keys.fill_null(0).to_numpy()[~lines])
    counts = [sums[x].to_numpy() for x in names]
    return found[order], [n[~lines][order] for n in counts], [int(n[lines].sum()) for n in counts]


def notices_of(parsed: DataFrame, rounds: int = 4, floor: float = 0.3) -> KeyedNotices:
    """learn_notices over all blocks: the same rounds, their counts added up by Spark. The driver holds a few copies of 24 bytes a word."""
    keys, (every, marked), (lines, many) = _key_counts(parsed, lambda block: [np.ones(len(block.sure), dtype=bool), block.sure], ["n", "sure"])
    found = KeyedNotices()
    for i in range(rounds):
        if not 0 < many < lines:
            break
        ratio = many / (lines - many)
        values = np.log((marked + floor) / ((every - marked) * ratio + floor))
        found = KeyedNotices(keys, np.round(values * 2.0**30) / 2.0**30, -math.log(ratio))
        if i + 1 < rounds:
            some, (n,), (many,) = _key_counts(parsed, lambda block, now=found: [block.sure | now.lines(block.once, block.keys)[block.shown]], ["n"])
            marked = np.zeros(len(keys), dtype=np.int64)
            marked[np.searchsorted(keys, some)] = n
    return found


def _spoken_words(block: Block, labeller: Labeller) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, (words, languages) counts) of the cues that are in one language by the labeller; misread texts apart."""
    n_langs = len(labeller.model.langs)
    for part, said, doc, cue, evidence in labeller.read(block):
        lang = np.full(len(doc), -1)
        for found in labeller.sequences(doc, cue, evidence):
            if found.states is None:
                lang[found.lines] = found.main
            else:
                lang[found.lines] = np.array([s[0] if len(s) == 1 else -1 for s in found.states])[found.owner(cue)]
        times = [np.bincount(said[lang == k], minlength=len(part.lines.sizes)) for k in range(n_langs)]
        yield part.words, np.stack([part.lines.counts(n, len(part.words)) for n in times], axis=1)


def word_counts(parsed: DataFrame, labeller: Labeller, sure: dict[str, Counter]) -> DataFrame:
    """(word, count of it in each language) over all blocks; sure: counts that are added four times."""
    langs = labeller.model.langs
    names = [f"n{i}" for i in range(len(langs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches):
            for words, counts in _spoken_words(block, labeller):
                some = np.flatnonzero(counts.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), *(pa.array(c, pa.int64()) for c in counts[some].T)], ["word", *names])

    schema = ", ".join(["word string", *(f"{x} long" for x in names)])
    rows = [(w, *(4 * sure[lang][w] for lang in langs)) for w in sorted({w for c in sure.values() for w in c})]
    return parsed.mapInArrow(run, schema).unionByName(parsed.sparkSession.createDataFrame(rows, schema)).groupBy("word").agg(*(F.sum(x).alias(x) for x in names))


def fit_words(counts: DataFrame, model: PieceModel) -> PieceModel:
    """fit (pieces.py) to word counts of any number; words are taken apart where they lie, only sums of pieces come to the driver."""
    pieces, n_langs = model.pieces, len(model.langs)
    names = [f"n{i}" for i in range(n_langs)]

    def expected(table: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, longest, found = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces), default=1), np.zeros_like(table)
            for batch in batches:
                weights = np.stack([batch.column(1 + k).to_numpy() for k in range(n_langs)], axis=1).astype(np.float64)
                found += expected_pieces(batch.column(0).to_pylist(), weights, index, longest, table, GRID)
            some = np.flatnonzero(found.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(found[some, k], pa.float64()) for k in range(n_langs))], ["piece", *names])

        rows = counts.mapInArrow(run, ", ".join(["piece int", *(f"{x} double" for x in names)]))
        sums = rows.groupBy("piece").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
        found = np.zeros_like(table)
        found[sums["piece"].to_numpy()] = np.stack([sums[x].to_numpy() for x in names], axis=1)
        return found

    return maximised(model.langs, pieces, expected)
