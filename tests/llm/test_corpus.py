import random

import numpy as np
import pytest

pytest.importorskip("fenceline.llm")

from pyspark.sql import functions as F  # noqa: E402

from fenceline.llm import queries  # noqa: E402
from fenceline.llm.corpus import block_of, coded  # noqa: E402
from fenceline.llm.cues import cues_of, looks_misread, notice_lines, spoken, words_of  # noqa: E402
from fenceline.llm.languages import Labeller, Settings  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PARTS = [
    "00:00:01,000 --> 00:00:02,000", "<i>00:00:01,000 --> 00:00:02,000</i>", "00:01 --> 00:02 <b>x</b>", "00:01.5 -> 00:02", "", " ", "12", " 7 ", "WEBVTT", "﻿WEBVTT x", "[door", "creaks] He said",
    "(sigh)", "♪ la la", "la ♪ Hello", "see www.x.test now", "https://abc", "a. b.cd ef", "Hello there.", "<font color=red>Ad by X</font>", "{\\an8}Go home", "Größe ÉTÉ", "ΟΔΟΣ", "ΟΔΟΣ.", "İstanbul I",
    "½ a1 ²", "\x0b x \x85", "Ã¼ber grÃ¶ÃŸer TÃ¼r", "* a * b", "#x", "x --> y", "site.example",
]


def some_texts(n, seed=1):
    r = random.Random(seed)
    usual = [x for x in PARTS if not looks_misread(x)]
    return [r.choice(["\n", "\r\n", "\r"]).join(r.choices(r.choice([PARTS, usual, usual]), k=r.randrange(30))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("learning", [True, False])
def test_block_has_the_lines_of_each_text_alone(learning):
    texts = some_texts(1500)
    block = block_of(texts, learning)
    ends = np.cumsum(block.lines.sizes)
    words = [[block.words[c] for c in block.lines.codes[end - n : end]] for end, n in zip(ends, block.lines.sizes)]
    shown = [(w, sure) for t in texts if t for line, sure in notice_lines(t) if (w := words_of(line))] if learning else []
    right = [(d, t) for d, t in enumerate(texts) if t and not looks_misread(t)]
    said = [(d, n, w) for d, t in right for n, lines in enumerate(cues_of(t), 1) for x in (spoken(lines) if lines else ()) if (w := words_of(x))]
    assert [(words[i], sure) for i, sure in zip(block.shown, block.sure)] == shown
    assert [(d, n, words[i]) for i, d, n in zip(block.said, block.doc, block.cue)] == said
    assert block.misread == [(d, t) for d, t in enumerate(texts) if t and looks_misread(t)]
    assert len(said) > 5000 and len(block.misread) > 100


def test_many_lines_are_coded_as_each_alone():
    lines = random.Random(3).choices(PARTS, k=40_000)
    words, got = coded(lines)
    assert [[words[c] for c in x] for x in np.split(got.codes, np.cumsum(got.sizes)[:-1])] == [words_of(x) for x in lines]
    assert coded([])[0] == []


@pytest.mark.parametrize("settings", [Settings(), Settings(main=6.0, change=20.0, both=12.0), Settings(main=0.0, both=0.5, both_in_one=0.0)])
def test_sequences_of_many_documents_are_those_of_each(settings):
    r = np.random.default_rng(2)
    labeller = Labeller(None, settings)
    doc = np.sort(r.integers(0, 400, 6000))
    cue = np.concatenate([np.sort(r.integers(1, 14, n)) for n in np.bincount(doc)])
    evidence = r.normal(0, 1, (6000, 5)) * r.choice([0.3, 2.0, 6.0], 400)[doc][:, None]
    evidence[:, 0] += r.choice([0.0, 3.0, 8.0], 400)[doc]
    known = set()
    for found in labeller.sequences(doc, cue, evidence):
        numbers, owner = np.unique(cue[found.lines], return_inverse=True)
        want = labeller.states(owner, evidence[found.lines], len(numbers))
        assert (found.states or [(found.main,)] * found.n_cues) == want and found.n_cues == len(numbers)
        assert np.array_equal(found.owner(cue), owner)
        known.add((found.states is None, set(want) == {(found.main,)}))
    assert {(True, True), (False, False)} <= known


@pytest.mark.parametrize("name", ["p8_found", "p8_languages"])
def test_documents_are_read_and_parsed_once(spark, monkeypatch, name):
    """By the fit and by the labelling together: each reading of a text is counted."""
    read = spark.sparkContext.accumulator(0)
    table = queries.table

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    def counting(spark, folder, name):
        return table(spark, folder, name).withColumn("text", counted("text")) if name == "documents" else table(spark, folder, name)

    monkeypatch.setattr(queries, "table", counting)
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert rows and read.value == table(spark, FOLDER, "documents").count()


def test_labelling_what_was_parsed_is_labelling_the_documents(spark):
    from fenceline.llm.languages import label_documents, train, train_and_label
    from fenceline.llm.tokens import TOKENIZERS

    docs, samples = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "lang_samples"))
    odd = docs.limit(3).selectExpr("cast(null as bigint) doc_id", "text", "lang").union(spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "", None)], "doc_id long, text string, lang string"))
    docs = docs.select("doc_id", "text", "lang").union(odd)
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    got, want = train_and_label(docs, samples, path), label_documents(docs, train(docs, samples, path))
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == docs.count()
    assert train_and_label(docs.limit(0), samples, path).count() == 0
