"""Sizes of texts in tokens of a public tokenizer.

The tokenizer is named by its file; the file is read by the workers and never
copied.  On a cluster the path has to exist on every machine.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = os.path.join(os.environ.get("NEARPRESS_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")

#: How this vocabulary cuts text into pieces before pairs are merged.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """A function that gives the number of tokens of a text, by the kind of file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(enc.encode_ordinary(text))
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(sp.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def token_count(col: Column | str, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of a text; null gives null, the empty text 0."""

    @F.arrow_udf("long")
    def n_tokens(values: pa.Array) -> pa.Array:
        count = counter(tokenizer)
        return pa.array([None if v is None else count(v) for v in values.to_pylist()], pa.int64())

    return n_tokens(F.col(col) if isinstance(col, str) else col)
