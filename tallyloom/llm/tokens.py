"""Sizes of texts in tokens of a public tokenizer; nothing is trained here."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TALLYLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits a text before byte pairs are merged, as this kind of vocabulary needs it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 200_000  # characters encoded at a time


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


# The end of a character that isn't white space before one that is. No match of SPLIT goes across such a place: what
# matches letters, digits or symbols takes no white space after them, and nothing looks behind. So a text that is cut
# there is split, and merged, as the whole is. The characters after it are those that every definition calls white space.
_END = re.compile(r"\S(?=[ \t\n\r])")


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text. Above CHUNK characters it is encoded in parts, each up to the first end of a word, or of other
    characters, at a space, tab or line's end beyond CHUNK; a text without any is encoded at once. The sum is that of the
    whole, whatever the text."""
    encode = encoder(path).encode_ordinary
    total, at = 0, 0
    while len(text) - at > CHUNK and (m := _END.search(text, at + CHUNK)):
        total += len(encode(text[at : m.end()]))
        at = m.end()
    return total + len(encode(text[at:]))


def with_tokens(df: DataFrame, text: str, path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """df with the text column replaced by its number of tokens (null for a null text): texts go to Python once and don't
    come back."""
    keep = [c for c in df.columns if c != text]
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if t is None else count_tokens(t, path) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, name])

    return df.select(*[F.col(c) for c in keep], F.col(text)).mapInArrow(run, fields)
