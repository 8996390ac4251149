import itertools
import random

import numpy as np
import pytest

pytest.importorskip("fenceline.llm")

from fenceline.llm.cues import words_of  # noqa: E402
from fenceline.llm.languages import Labeller, Settings, held_languages, label_documents, not_named, train  # noqa: E402
from fenceline.llm.tokens import TOKENIZERS  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, n_cues int, segments string"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "lang_samples", "lang_names")}


@pytest.fixture(scope="module")
def labeller(tables):
    return train(tables["documents"], tables["lang_samples"], f"{TOKENIZERS}/piece_bpe_32k.model", most_docs=300)


@pytest.fixture(scope="module")
def sentences(tables):
    """Sentences of each language that no training saw: clean samples joined in new orders."""
    by = {}
    for r in tables["lang_samples"].collect():
        by.setdefault(r["lang"], []).extend(s.strip() + "." for s in r["text"].split(".") if len(s) > 12)
    return by


def subtitle(cues, end="\n"):
    return end.join(f"{i}{end}00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900{end}{end.join(c)}{end}" for i, c in enumerate(cues, 1))


def found(spark, labeller, texts):
    docs = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    out = {i: set() for i in range(len(texts))}
    for r in held_languages(label_documents(docs, labeller)).collect():
        out[r["doc_id"]].add(r["lang_found"])
        assert 0.5 < r["confidence"] <= 1
    return [out[i] for i in range(len(texts))]


def test_planted_languages_are_found(spark, labeller, sentences):
    r = random.Random(4)
    cases, want = [], []
    for n in range(60):
        a, b = r.sample(sorted(sentences), 2)
        pick = lambda k: [r.choice(sentences[k])]
        run = r.choice([3, 4, 5, 6, 9])
        middle = [pick(b) for _ in range(run)]
        if n % 3 == 0:  # what isn't dialogue doesn't break a sequence
            middle[2:2] = [["[door creaks]"], ["Subtitles by team QuietReef"], ["♪ ♪"], ["123"], ["See www.site.test"]]
        cues = [pick(a) for _ in range(8)] + middle + [pick(a) for _ in range(8)]
        if n % 5 == 4:
            cues = [[*pick(a), *pick(b)] for _ in range(run)]
        text = subtitle(cues, r.choice(["\n", "\r\n"]))
        if n % 7 == 3:
            text = text.encode().decode("cp1252", "ignore") if "\x81" not in text else text
        if n % 4 == 1:
            text = text.lower()
        cases.append(text)
        want.append({a, b} if run >= 5 or n % 5 == 4 else {a})
    got = found(spark, labeller, cases)
    assert sum(g == w for g, w in zip(got, want)) >= 57, [(g, w) for g, w in zip(got, want) if g != w]


def test_short_documents(spark, labeller, sentences):
    en, de = sentences["en"], sentences["de"]
    texts = [subtitle([[en[0]]]), subtitle([[en[0]], [de[0]]]), subtitle([[de[0]], ["[sighs]"], [de[1]], [de[2]], [de[3]]])]
    assert found(spark, labeller, texts) == [{"en"}, set(), {"de"}]


def test_nothing_to_label(spark, labeller):
    texts = [None, "", " \n", subtitle([["♪ ♪"], ["12"], ["[x]"]]), "WEBVTT\n\n"]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = label_documents(docs, labeller).collect()
    assert [r["n_cues"] for r in got] == [0] * 5 and all(not r["segments"] for r in got)
    assert label_documents(docs.limit(0), labeller).count() == 0


def test_very_long_text_and_repeated_rows(spark, labeller, sentences):
    text = subtitle([[sentences["sv"][i % 20]] for i in range(20_000)])
    docs = spark.createDataFrame([(None, text, "sv", 1, "x"), (1, text, "sv", 1, "x"), (1, text, "sv", 1, "x"), (2, "a" * 300_000, "sv", 1, "x")], SCHEMA)
    got = label_documents(docs, labeller).collect()
    assert [r["n_cues"] for r in got] == [20_000, 20_000, 20_000, 1]
    assert [s["lang"] for s in got[0]["segments"]] == ["sv"] and got[0]["segments"][0]["n_cues"] == 20_000


def test_labels(spark, rows):
    held = spark.createDataFrame([(1, "English ", "en"), (2, "EN", "de"), (3, None, "en"), (4, "und", "en"), (5, "what", "en")], "doc_id long, label string, lang_found string")
    names = spark.createDataFrame([("english", "en"), ("en", "en"), ("EN ", "en"), ("und", None), ("", None)], "label_form string, lang string")
    assert rows(not_named(held, names).select("doc_id", "lang_found")) == [(2, "de"), (3, "en"), (4, "en"), (5, "en")]


def test_held_out_accuracy_on_labelled_documents(spark, tables, labeller):
    """Most labels are right, so the main language of most documents must be the labelled one."""
    named = tables["lang_names"].filter("lang is not null").selectExpr("lower(trim(label_form)) f", "lang as named")
    labelled = label_documents(tables["documents"], labeller).filter("n_cues > 0").selectExpr("*", "lower(trim(label)) f").join(named, "f")
    main = labelled.selectExpr("named", "array_max(transform(segments, s -> struct(s.n_cues, s.lang))).lang main")
    agree = main.selectExpr("avg(int(named = main))").first()[0]
    assert agree > 0.85


def test_training_without_documents(tables):
    model = train(tables["documents"].limit(0), tables["lang_samples"], f"{TOKENIZERS}/piece_bpe_32k.model")
    assert len(model.model.langs) == 10 and model.label("Das ist nicht einfach, die Wahrheit zu kennen.")[0][0] == "de"


def test_no_language_is_left_out_of_the_sequence():
    """A stretch is found although four other languages gain more over the main one, line by line over the whole file."""
    n = 400
    evidence = np.full((n, 10), -20.0)
    evidence[:, 0] = 0.0
    for k in (1, 2, 3, 4):
        evidence[k::8, k] = 4.0
    evidence[200:205, 9] = 12.0
    states = Labeller(None).states(np.arange(n), evidence, n)
    assert [i for i, s in enumerate(states) if s == (9,)] == [200, 201, 202, 203, 204]
    assert {s for i, s in enumerate(states) if not 200 <= i < 205} == {(0,)}


def test_sequence_is_the_best_of_all():
    r = np.random.default_rng(5)
    settings = Settings()
    named = [(k,) for k in range(6)] + [(a, b) for a in range(6) for b in range(a + 1, 6)]
    for scale in (1, 3, 8, 20) * 2:
        owner = np.sort(np.append(np.arange(3), r.integers(0, 3, 2)))
        evidence = r.normal(0, scale, (5, 6))
        main = int(evidence.sum(axis=0).argmax())

        def worth(i, state):
            lines = evidence[owner == i][:, list(state)].max(axis=1)
            both = settings.both + (settings.both_in_one if len(lines) < 2 else 0.0)
            return lines.sum() + (settings.main if state == (main,) else 0.0) - (both if len(state) == 2 else 0.0)

        table = [{s: worth(i, s) for s in named} for i in range(3)]
        value = lambda path: sum(table[i][tuple(sorted(s))] for i, s in enumerate(path)) - settings.change * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(named, repeat=3))
        assert value(Labeller(None, settings).states(owner, evidence, 3)) == pytest.approx(best)


def test_every_document_has_a_main_language_or_null(spark, labeller, sentences):
    en, de = ([[s] for s in sentences[k]] for k in ("en", "de"))
    texts = [subtitle(de[:12]), subtitle(en[:14] + de[:6]), subtitle(en[:2] + de[:9]), None, "", subtitle([["♪ ♪"], ["[x]"]])]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = label_documents(docs, labeller).orderBy("doc_id").collect()
    assert [r["lang"] for r in got] == ["de", "en", "de", None, None, None]
    assert all(0.5 < r["confidence"] <= 1 for r in got[:3]) and all(r["confidence"] is None for r in got[3:])


def test_training_sees_every_document_whole(spark, tables):
    """Each of 1,600 documents, and the end of one of over 20,000 characters, has a notice in words of its own, seen nowhere else."""
    talk = ["Where did you put the keys?", "Nobody told me about it.", "Come here, quickly.", "We have to leave now."]
    notice = lambda i: f'<font color="red">kaannos{i} tekstitys{i}</font>'
    texts = [subtitle([[x] for x in (*talk, notice(i))]) for i in range(1600)] + [subtitle([[talk[i % 4]] for i in range(600)] + [[notice(1600)]])]
    assert len(texts[-1]) > 20_000
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = train(docs, tables["lang_samples"], f"{TOKENIZERS}/piece_bpe_32k.model", rounds=0)
    assert all(got.notices.holds([f"kaannos{i}", f"tekstitys{i}"]) for i in range(1601))
    assert not any(got.notices.holds(words_of(x)) for x in talk)


def test_fit_counts_every_document_whatever_its_place(spark, tables):
    """A word that one of 1,600 documents repeats is learnt for its language, and the tasks don't change the model."""
    en = ["Where did you put the keys?", "Nobody told me about it.", "Come here, quickly.", "We have to leave now."]
    texts = [subtitle([[x] for x in en[:1]])] * 1600 + [subtitle([[en[i % 4] + " Vuolqx"] for i in range(600)])]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    model, other = (train(d, tables["lang_samples"], f"{TOKENIZERS}/piece_bpe_32k.model", rounds=1).model for d in (docs, docs.repartition(3)))
    relative = model.relative()[model.ids(["vuolqx"])][0]
    assert model.langs[int(relative.argmax())] == "en" and relative.max() > 1
    assert np.array_equal(model.table, other.table)
