"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column

from probatum.functions.arrow import arrow

DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: Characters handed to the tokenizer at a time; longer texts are cut at blanks, where no token spans.
CHUNK = 100_000


def tokenizer_path(file: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(file))


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Number of tokens; 0 for null and empty texts. Text that spells a special token is ordinary text."""
    if not text:
        return 0
    encoding = _encoding(path)
    if len(text) <= CHUNK:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        total += len(encoding.encode_ordinary(text[at:end]))
        at = end
    return total


def token_count(text: Column | str, path: str | None = None) -> Column:
    path = path or tokenizer_path()

    @arrow("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, path)).astype("int32")

    return count(text)
