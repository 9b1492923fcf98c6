"""Counting tokens with a public tokenizer; the vocabulary file is a parameter and is read where it lies."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tiktoken rank file; any path that the executors can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters per piece that is encoded at once; longer texts are cut at line ends or blanks, else here.
PIECE = 100_000

_encoders: dict = {}


def encoder(vocabulary: str):
    """The encoder of a rank file, made once per Python worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _pieces(text: str) -> Iterator[str]:
    while len(text) > PIECE:
        cut = max(text.rfind("\n", 0, PIECE), text.rfind(" ", 0, PIECE))
        cut = cut if cut > 0 else PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for NULL and empty texts. Whole texts are counted, in Arrow batches."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.Series([sum(len(encode(p)) for p in _pieces(t)) if t else 0 for t in batch], dtype="int64")

    return count(text)
