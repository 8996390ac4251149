import random

import pytest

pytest.importorskip("fenceline.llm")

from fenceline.llm.cues import Notices, cues_of, learn_notices, looks_misread, repaired, spoken, words_of  # noqa: E402


def test_cues_in_all_notations():
    times = ["00:00:01,000 --> 00:00:02,000", "0:00:01,00-->0:00:02,00", "00:01.000 -> 00:02.000", " 1:02:03.4 --> 1:02:04.5 position:10%"]
    for t in times:
        for end in ("\n", "\r\n", "\r"):
            text = end.join(["WEBVTT - x", "", "1", t, "<i>One</i>", "two", "", "2", t, "{\\an8}Three", "3", t, ""])
            assert cues_of(text) == [["One", "two"], ["Three"], []], (t, end)


def test_text_without_times():
    assert cues_of("a line\n\nanother") == [["a line"], [], ["another"]]
    assert cues_of("") == [[]]


@pytest.mark.parametrize(
    "line,left",
    [
        ("[dog barking]", ""), ("(DOG BARKING)", ""), ("*sighs*", ""), ("♪ soft music ♪", ""), ("* * *", ""), ("[ ♪ ]", ""), ("♫", ""), ("[soft piano music", ""),
        ("[sighs] I know.", "I know."), ("♪♪♪ I know.", "I know."), ("[dog barking What do you want?", "What do you want?"), ("- I know.", "- I know."), ("...", ""), ("92", ""),
        ("Watch more at www.site.test", ""), ("See site.example", ""), ("Years ago. I know.", "Years ago. I know."), ("At 8.45 we go", "At 8.45 we go"),
    ],
)
def test_spoken(line, left):
    assert " ".join(" ".join(x for x in spoken([line]) if words_of(x)).split()) == left


def test_words():
    assert words_of("L'Été wa1ting 8:45 a_b") == ["l", "été", "wa1ting", "a", "b"]


@pytest.mark.parametrize("written,read", [("utf-8", "cp1252"), ("utf-8", "cp1250"), ("cp1250", "cp1252"), ("cp1251", "cp1252")])
def test_misread_text_is_repaired(written, read):
    text = {"cp1251": "Почему это здесь", "cp1250": "Odłóż to i cofnij się"}.get(written, "Über größere Tür")
    known = set(words_of(text))
    bad = text.encode(written).decode(read)
    score = lambda x: sum(w in known for w in words_of(x)) - 0.01 * len(x)
    assert bad != text and looks_misread(bad) and not looks_misread(text)
    assert repaired(bad, score) == text
    assert repaired(text, score) == text


def test_twice_misread_and_lost_bytes():
    text = "Qué está mañana"
    bad = text.encode().decode("cp1252").encode().decode("latin-1")
    score = lambda x: sum(w in words_of(text) for w in words_of(x)) - 0.01 * len(x)
    assert repaired(bad, score) == text
    lost = "Потом".encode().decode("cp1250", "replace")
    assert "п" in repaired(lost, lambda x: sum(c in "Потм" for c in x) / len(x)).lower()


TEAMS = ["QuietReef", "TwoMoons", "Ovalis", "Nordwick"]
TALK = ["tule tänne heti", "missä avain on", "en tiedä mitään siitä", "kello on jo paljon", "sulje ikkuna nyt", "hän sanoi niin eilen", "team work is what we need"]


def film(r, notice):
    """Dialogue in a language that no model here knows, with one notice, sometimes coloured."""
    cues = [r.choice(TALK) + " " + r.choice(["Anna", "Veikko", "Lunet"]) for _ in range(20)]
    cues[r.randrange(20)] = notice
    return "\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}\n" for i, c in enumerate(cues, 1))


def test_notices_are_learnt_in_any_language():
    r = random.Random(2)
    line = lambda: r.choice(["Tekstitys: {}", "Synkronointi ja oikoluku {}"]).format(r.choice(TEAMS))
    texts = [film(r, f'<font color="#ffff00">{line()}</font>' if i % 3 == 0 else line()) for i in range(60)]
    notices = learn_notices([*texts, "", "no cues here"])
    for frame in ("Tekstitys: {}", "Synkronointi ja oikoluku {}"):
        assert all(notices.holds(words_of(frame.format(t))) for t in TEAMS)
    assert notices.holds(words_of("Tekstitys: Aivan Uusi"))
    assert not any(notices.holds(words_of(t)) for t in TALK)
    assert not notices.holds([]) and not notices.holds(["never", "seen"])


def test_coloured_dialogue_is_no_notice():
    r = random.Random(3)
    texts = [film(r, f'<font color="red">{r.choice(TALK)}</font>') for _ in range(60)] + [film(r, f'<font color="red">Tekstitys: {r.choice(TEAMS)}</font>') for _ in range(20)]
    notices = learn_notices(texts)
    assert notices.holds(words_of("Tekstitys: Ovalis")) and not any(notices.holds(words_of(t)) for t in TALK)


def test_nothing_to_learn_notices_from():
    for texts in ([], [""], [film(random.Random(1), "Tekstitys: Ovalis")]):
        assert learn_notices(texts) == Notices() and not learn_notices(texts).holds(["tekstitys"])
