import time
from pathlib import Path

import pytest

pytest.importorskip("fenceline.llm")

from fenceline.llm.cues import cues_of, spoken, words_of  # noqa: E402
from fenceline.llm.tokens import PATTERN, TOKENIZERS, VOCABULARY, _encoding, token_count, with_token_counts  # noqa: E402


@pytest.fixture(scope="module")
def encoding():
    return _encoding(Path(VOCABULARY).read_bytes())


def test_equals_the_other_library(encoding):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("", "It's 10:15, isn't it?\n\n", "Położył 🙂 <|endoftext|>", "  a \t b\r\n", "что это"):
        assert token_count(encoding, text) == len(other.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "　"])
def test_runs_of_white_space(encoding, blank):
    """Runs just under and over the limit of what is cut out count alike."""
    import regex

    def plain(text):
        return sum(len(encoding._encode_single_piece(x)) for x in regex.findall(PATTERN, text))

    for n in (4095, 4096, 4097, 9000):
        for text in (blank * n, "a" + blank * n, blank * n + "b", "a" + blank * n + "b c" + blank * n + "!", blank * n + " " + "x"):
            assert token_count(encoding, text) == plain(text)


def test_very_long_texts(spark):
    texts = [" " * 3_000_000 + "x", "\n" * 1_000_000, "a" * 1_000_000, "word " * 500_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in with_token_counts(df, ["id"]).collect()}
    assert got[4] == got[5] == 0 and got[3] == 500_001 and min(got[0], got[1], got[2]) > 0


@pytest.mark.parametrize("text", ["a" * 500_000 + ".", "#" * 500_000 + "x", "[" * 500_000, "(a" * 200_000, "*" * 500_001, "<" * 500_000, "a." * 300_000, " " * 500_000 + ".", "1:" * 300_000])
def test_odd_texts_take_linear_time(text):
    began = time.process_time()
    for lines in cues_of(text):
        for x in spoken(lines):
            words_of(x)
    assert time.process_time() - began < 5
