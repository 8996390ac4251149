"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: How the vocabulary's texts are cut before merging; part of its public definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longer runs of white space overflow the pattern's matching; they are cut out by the pattern's own rule.
_LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")

_built: dict[int, object] = {}


def _encoding(ranks_file: bytes):
    """One encoding a worker process."""
    known = hash(ranks_file)
    if known not in _built:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file.splitlines() if line)}
        _built[known] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _built[known]


def token_count(encoding, text: str) -> int:
    """Tokens of a text of any length."""
    if len(text) < 4096 or not (blank := _LONG_BLANK.search(text)):
        return len(encoding.encode_ordinary(text))
    n, at = 0, 0
    while blank:
        n += len(encoding.encode_ordinary(text[at : blank.start()]))
        # a run is one piece, but for its last character where something follows
        at = blank.end() - (blank.end() < len(text))
        n += len(encoding._encode_single_piece(text[blank.start() : at]))
        blank = _LONG_BLANK.search(text, blank.end())
    return n + len(encoding.encode_ordinary(text[at:]))


def with_token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., n_tokens): tokens of the whole text, 0 for null and empty ones.

    The vocabulary is read on the driver and sent along, so executors need no such file. No shuffle; only the kept
    columns and the text are read. Texts go through one at a time, so memory doesn't depend on their number.
    """
    ranks_file = Path(vocabulary).read_bytes()
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_file)
        for batch in batches:
            sizes = [token_count(encoding, x.as_py()) if x.is_valid else 0 for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, fields + ", n_tokens bigint")
