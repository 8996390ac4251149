"""Languages of documents and of stretches of cues in them, with confidence."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_name
from ..session import discard, scratch, written
from .corpus import Block, KeyedNotices, Lines, block_of, block_of_cues, blocks, fit_words, notices_of, unpacked, word_counts
from .cues import all_repaired, cues_of, words_of
from .pieces import PieceModel, fit, read_pieces

SEGMENTS = "array<struct<lang:string,first_cue:int,last_cue:int,n_cues:int,confidence:double>>"


@dataclass
class Settings:
    """Costs in units of log probability."""

    #: Cues in a row that must contain a language for a document to hold it; shorter documents must contain it throughout.
    least_run: int = 5
    #: Cost of a change of language between two cues.
    change: float = 5.0
    #: Cost of a cue in two languages, and of one that has only one line for them.
    both: float = 5.0
    both_in_one: float = 4.0
    #: What the document's main language is favoured by in each cue.
    main: float = 0.5
    #: Divides evidence before it is turned into a confidence: neighbouring words aren't independent.
    temper: float = 4.0
    #: Documents scored at a time; bounds memory.
    slice_docs: int = 256


class _Odd(dict):
    """Whether a character is in no word nor usual between words."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = not (c.isalnum() or c.isspace() or c in ".,;:!?¿¡'\"-–—…()[]«»„“”♪♫#*&%/")
        return found


_ODD = _Odd()


@dataclass
class Sequence:
    """The languages of a document's cues; no states: all of them are in the main one."""

    doc: int
    lines: slice
    n_cues: int
    main: int
    states: list[tuple[int, ...]] | None

    def owner(self, cue: np.ndarray) -> np.ndarray:
        """The place among the document's dialogue cues of each line's."""
        return np.cumsum(np.diff(cue[self.lines], prepend=cue[self.lines.start]) != 0)


def _best_stretch(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest sum of neighbours in each part of gain; first: where the parts start."""
    upto = np.cumsum(gain)
    before = upto - gain
    # every part starts lower than all before it, so that the least sum so far is one of its own
    down = (np.ptp(np.append(upto, 0.0)) + 1.0) * np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gain))))
    return np.maximum.reduceat(upto - down - np.minimum.accumulate(before - down), first)


@dataclass
class Labeller:
    """Scores and segments texts; sent to the executors."""

    model: PieceModel
    settings: Settings = field(default_factory=Settings)
    notices: KeyedNotices = field(default_factory=KeyedNotices)

    def _likelihoods(self, lines: list[str]) -> list[float]:
        said = [words_of(line) for line in lines]
        ids = self.model.ids([w for words in said for w in words])
        values = self.model.plain()[ids]
        ends = np.cumsum([len(words) for words in said]).tolist()
        # characters that are in no word, as wrong readings have them, count as unknown ones
        return [float(values[end - len(words) : end].sum()) - 12.0 * sum(map(_ODD.__getitem__, line)) for line, words, end in zip(lines, said, ends)]

    def reread(self, misread: list[tuple[int, str]]) -> Block:
        """The lines of texts in a wrong encoding, repaired."""
        cues = [(d, number, lines) for d, text in misread for number, lines in enumerate(cues_of(text), 1) if lines]
        right = all_repaired({x for _, _, lines in cues for x in lines}, self._likelihoods)
        return block_of_cues((d, number, [right[x] for x in lines]) for d, number, lines in cues)

    def evidence(self, lines: Lines, words: list[str]) -> np.ndarray:
        """(lines, languages) evidence of lines of these words."""
        ids = self.model.ids(words)
        return lines.sums(self.model.relative()[ids]).astype(np.float64)

    def read(self, block: Block) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, lines of dialogue in it, document and cue of each, (lines, languages) evidence) of the block and of its misread texts, repaired."""
        for part in (block, self.reread(block.misread)) if block.misread else (block,):
            said, doc, cue = part.dialogue(self.notices)
            yield part, said, doc, cue, self.evidence(part.lines, part.words)[said]

    def sequences(self, doc: np.ndarray, cue: np.ndarray, evidence: np.ndarray) -> Iterator[Sequence]:
        """The likeliest sequence of each document that has lines; those that can only be in one language throughout are found together."""
        if not len(doc):
            return
        s = self.settings
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        cues = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(cue, prepend=-1))
        inside = np.searchsorted(cues, first)
        ends, counts = np.append(first, len(doc)), np.diff(np.append(inside, len(cues)))
        by_cue = np.add.reduceat(evidence, cues, axis=0)
        mains = np.add.reduceat(by_cue, inside, axis=0).argmax(axis=1)
        # the most that a cue gains in other languages, and with all its lines in the best one
        single = by_cue.max(axis=1) - by_cue[np.arange(len(cues)), np.repeat(mains, counts)]
        lines = evidence.max(axis=1) - evidence[np.arange(len(doc)), np.repeat(mains, np.diff(ends))]
        both = np.add.reduceat(lines, cues) - s.both - np.where(np.diff(np.append(cues, len(doc))) < 2, s.both_in_one, 0.0)
        gain = np.maximum(single, both) - s.main
        # leaving the main language for a stretch costs a change at least, so none pays if none gains as much; two languages
        # throughout cost no change, but pay only if the lines gain more than both in every cue; a little is left for rounding
        alone = (_best_stretch(gain, inside) <= s.change - 1e-3) & (np.add.reduceat(lines, first) <= counts * s.both - 1e-3)
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            found = Sequence(int(doc[a]), slice(a, b), int(counts[i]), int(mains[i]), None)
            if not alone[i]:
                found.states = self.states(found.owner(cue), evidence[a:b], found.n_cues)
            yield found

    def states(self, owner: np.ndarray, evidence: np.ndarray, n_cues: int) -> list[tuple[int, ...]]:
        """The language or two languages of each dialogue cue, by the likeliest sequence."""
        s = self.settings
        starts = np.searchsorted(owner, np.arange(n_cues))
        cues = np.add.reduceat(evidence, starts, axis=0)
        total = cues.sum(axis=0)
        main = int(total.argmax())
        gain = np.maximum(evidence - evidence[:, [main]], 0)
        # what any sequence can gain doesn't pay for a change, nor for two languages a cue
        if gain.max(axis=1).sum() <= min(s.change, s.both):
            return [(main,)] * n_cues
        # a language that is better than the main one in no line is in no likeliest sequence; all others get a state
        single = [main, *(int(k) for k in np.flatnonzero(gain.sum(axis=0) > 0))]
        pairs = [(a, b) for i, a in enumerate(single) for b in single[i + 1 :]]
        first, second = [a for a, _ in pairs], [b for _, b in pairs]
        ends = np.append(starts, len(owner))
        table = np.empty((n_cues, len(single) + len(pairs)))
        table[:, : len(single)] = cues[:, single]
        table[:, 0] += s.main
        for i in range(0, n_cues, 1024):  # bounds memory
            j = min(i + 1024, n_cues)
            lines = evidence[ends[i] : ends[j]]
            table[i:j, len(single) :] = np.add.reduceat(np.maximum(lines[:, first], lines[:, second]), starts[i:j] - ends[i], axis=0)
        table[:, len(single) :] -= s.both + np.where(np.diff(ends) < 2, s.both_in_one, 0.0)[:, None]
        best, stay, tops = table[0].copy(), np.empty(table.shape, dtype=bool), np.zeros(n_cues, dtype=np.int64)
        for i in range(1, n_cues):
            tops[i] = top = best.argmax()
            least = best[top] - s.change
            np.greater_equal(best, least, out=stay[i])
            np.maximum(best, least, out=best)
            best += table[i]
        state = int(best.argmax())
        path = [state]
        for i in range(n_cues - 1, 0, -1):
            if not stay[i, state]:
                state = int(tops[i])
            path.append(state)
        named: list[tuple[int, ...]] = [(k,) for k in single] + pairs
        return [named[k] for k in reversed(path)]

    def posterior(self, total: np.ndarray) -> np.ndarray:
        """The confidence in each language for lines of this evidence together."""
        total = total / self.settings.temper
        weights = np.exp(total - total.max(axis=-1, keepdims=True))
        return weights / weights.sum(axis=-1, keepdims=True)

    def segments(self, states: list[tuple[int, ...]], numbers: np.ndarray, owner: np.ndarray, evidence: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """Every run of dialogue cues that contain a language: (lang, first cue, last cue, cues, confidence)."""
        n = len(numbers)
        single = np.array([len(state) == 1 for state in states])
        ends = np.searchsorted(owner, np.arange(n + 1))
        out = []
        for k in sorted({k for state in states for k in state}):
            inside = [k in state for state in states]
            i = 0
            while i < n:
                if not inside[i]:
                    i += 1
                    continue
                j = i
                while j < n and inside[j]:
                    j += 1
                lines = slice(ends[i], ends[j])
                here = evidence[lines]
                # in a cue of two languages, a line speaks for the language it is in
                mine = single[owner[lines]] | (here[:, k] >= here.max(axis=1) - 1e-9)
                out.append((self.model.langs[k], int(numbers[i]), int(numbers[j - 1]), j - i, float(self.posterior(here[mine].sum(axis=0))[k])))
                i = j
        return sorted(out, key=lambda x: (x[1], x[0]))

    def labels(self, block: Block) -> dict[int, tuple[int, str, float, list[tuple[str, int, int, int, float]]]]:
        """(cues, main language, confidence, segments) of each of the block's documents that have dialogue.

        The main language is the one with the most evidence over all lines.
        """
        out = {}
        langs = self.model.langs
        for _, _, doc, cue, evidence in self.read(block):
            if not len(doc):
                continue
            totals = np.add.reduceat(evidence, np.flatnonzero(np.diff(doc, prepend=-1)), axis=0)
            sure, main = self.posterior(totals), totals.argmax(axis=1).tolist()
            for i, found in enumerate(self.sequences(doc, cue, evidence)):
                at = found.lines
                if found.states is None:
                    segments = [(langs[found.main], int(cue[at.start]), int(cue[at.stop - 1]), found.n_cues, float(sure[i, found.main]))]
                else:
                    owner = found.owner(cue)
                    numbers = cue[at][np.flatnonzero(np.diff(owner, prepend=-1))]
                    segments = self.segments(found.states, numbers, owner, evidence[at])
                out[found.doc] = (found.n_cues, langs[main[i]], float(sure[i, main[i]]), segments)
        return out

    def label(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        found = self.labels(block_of([text], learning=False))
        return found[0][3] if found else []

    def held(self, segments: list[tuple[str, int, int, int, float]], n_cues: int) -> set[str]:
        need = min(self.settings.least_run, n_cues)
        return {lang for lang, _, _, n, _ in segments if n >= need}


def train(docs: DataFrame, samples: DataFrame, model_path: str, key: str = "doc_id", most_docs: int | None = None, rounds: int = 2) -> Labeller:
    """Fit the languages' piece probabilities.

    First on samples (lang, text), clean sentences, then on all documents, read whole: each round labels their cues with the
    model so far, whatever their label says, and counts the words. What tells credits and adverts from dialogue is learnt from
    the same documents. They are parsed once into blocks that every pass reads; counts are added up by Spark. most_docs, if
    given: fit on so many documents only, those with the lowest hash of key and text.

    A change of language is made dear in the rounds: a sentence that the model so far takes for a neighbouring language counts
    for the one of the cues around it, so that such an error isn't learnt.
    """
    model, base = _first_model(samples, model_path)
    if most_docs is not None:
        docs = docs.filter(F.length("text") > 0).orderBy(F.xxhash64(key, "text"), "text").limit(most_docs)
    with scratch():
        return _fitted(written(blocks(docs.filter(F.length("text") > 0)), "p8-blocks"), model, base, rounds)


def _first_model(samples: DataFrame, model_path: str) -> tuple[PieceModel, dict[str, Counter]]:
    """The model by the samples, and their words."""
    clean = [(r["lang"], r["text"]) for r in samples.select("lang", "text").collect() if r["lang"] and r["text"]]
    base: dict[str, Counter] = defaultdict(Counter)
    for lang, text in clean:
        base[lang].update(words_of(text))
    return fit(sorted({lang for lang, _ in clean}), read_pieces(model_path), base), base


def _fitted(parsed: DataFrame, model: PieceModel, base: dict[str, Counter], rounds: int) -> Labeller:
    only = parsed.select("block")
    notices = notices_of(only)
    for _ in range(rounds):
        steady = Labeller(model, Settings(main=6.0, change=20.0, both=12.0), notices)
        counts = written(word_counts(only, steady, base), "p8-words")
        model = fit_words(counts, model)
        discard(counts)
    return Labeller(model, notices=notices)


def label_documents(docs: DataFrame, labeller: Labeller, key: str = "doc_id") -> DataFrame:
    """(key, label, n_cues, lang, confidence, segments): the main language, and the runs of dialogue cues in each language.

    The main language is the one with the most evidence over the whole text, whatever others it holds; a confidence is between
    0 and 1. Null, blank and dialogue-free texts have a null language and confidence, no cues and no segments. Texts are read whole. Repeated documents are labelled
    each. Other columns are ignored. An empty input gives an empty result. There is no shuffle: a document is labelled
    where it is read.
    """
    rows = docs.select(F.col(key).alias("k"), F.col("lang").alias("label"), F.col("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = labeller.settings.slice_docs
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield _label_rows(batch.column(0), batch.column(1), labeller.labels(block_of(batch.column(2).to_pylist(), learning=False)))

    return rows.mapInArrow(run, _schema(kind)).withColumnRenamed("k", key)


def train_and_label(docs: DataFrame, samples: DataFrame, model_path: str, key: str = "doc_id", rounds: int = 2) -> DataFrame:
    """What label_documents gives with a labeller that train fitted on the same documents, which are parsed once for both.

    The blocks stay in the shared folder, as the result reads them.
    """
    model, base = _first_model(samples, model_path)
    rows = docs.select(F.col(key).alias("k"), F.col("lang").alias("label"), F.col("text"))
    parsed = written(blocks(rows, "k", "label"), "p8-blocks")
    labeller = _fitted(parsed, model, base, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, labels in zip(*batch.columns):
                yield _label_rows(keys.values, labels.values, labeller.labels(unpacked(block.as_py())))

    return parsed.mapInArrow(run, _schema(rows.schema["k"].dataType.simpleString())).withColumnRenamed("k", key)


def _schema(kind: str) -> str:
    return f"k {kind}, label string, n_cues int, lang string, confidence double, segments {SEGMENTS}"


def _label_rows(keys: pa.Array, labels: pa.Array, found: dict[int, tuple[int, str, float, list[tuple[str, int, int, int, float]]]]) -> pa.RecordBatch:
    """found: as Labeller.labels gives it, by the place of a document's key."""
    sizes, langs, sure, segments = zip(*(found.get(d, (0, None, None, [])) for d in range(len(keys)))) if len(keys) else ((), (), (), ())
    names = ("lang", "first_cue", "last_cue", "n_cues", "confidence")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    flat = [x for some in segments for x in some]
    parts = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)], list(names))
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, segments)]), pa.int32()), parts)
    arrays = [keys, labels, pa.array(sizes, pa.int32()), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), listed]
    return pa.RecordBatch.from_arrays(arrays, ["k", "label", "n_cues", "lang", "confidence", "segments"])


def held_languages(labelled: DataFrame, key: str = "doc_id", least_run: int = 5) -> DataFrame:
    """(key, label, lang_found, confidence) for each language a document holds: least_run dialogue cues in a row, or all of fewer."""
    long = F.filter("segments", lambda x: x["n_cues"] >= F.least(F.lit(least_run), F.col("n_cues")))
    langs = F.array_distinct(F.transform("long", lambda x: x["lang"]))
    sure = lambda lang: F.array_max(F.transform(F.filter("long", lambda x: x["lang"] == lang), lambda x: x["confidence"]))
    held = F.transform(langs, lambda x: F.struct(x.alias("lang_found"), sure(x).alias("confidence")))
    return labelled.withColumn("long", long).select(key, "label", F.inline(held))


def not_named(held: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of held whose label doesn't name the language; names: (label_form, lang), compared trimmed and ignoring case.

    A label in no form of names, a null or blank one, and a form without a language name none.
    """
    known = names.select(clean_name("label_form").alias("form"), F.col("lang").alias("lang_found")).na.drop()
    labelled = held.withColumn("form", clean_name("label"))
    return labelled.join(F.broadcast(known), ["form", "lang_found"], "left_anti").drop("form")  # names: a fixed table of forms
