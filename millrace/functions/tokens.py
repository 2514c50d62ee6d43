"""Token counts by a public tokenizer's file, in Arrow batches. A file that isn't there is refused, so that no estimate passes for a count."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public tokenizers' files lie, unless a path is given.
FOLDER = "/opt/tokenizers"
# How byte-level tokenizers cut a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chat of one turn: what the prompt becomes, and what the answer adds to it.
TEMPLATE = ("<|user|>\n{}\n<|assistant|>\n", "{}\n")
_LOADED: dict[str, Callable[[list[str]], list[list[int]]]] = {}


class UnknownTokenizer(ValueError):
    """There is no such tokenizer here."""


def known(name: str) -> str:
    """The path of a tokenizer's file, given itself or by its name in FOLDER."""
    for path in (name, os.path.join(FOLDER, name)):
        if os.path.isfile(path):
            return path
    raise UnknownTokenizer(f"unknown tokenizer {name!r}; give a file or token lengths as columns")


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts, special tokens' strings taken as ordinary text; loaded once for a process. By ending: .tiktoken, .json or .model."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [own.encode_ordinary(t) for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            _LOADED[path] = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: pieces.encode(texts, num_threads=1)
    return _LOADED[path]


def count(text: Column, tokenizer: str) -> Column:
    """How many tokens a text has; null has none."""
    path = known(tokenizer)

    @F.pandas_udf(T.IntegerType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for s in batches:
            yield pd.Series([len(ids) for ids in encode(s.fillna("").tolist())], dtype="int32")

    return counted(text)


def chat_lengths(prompt: Column, answer: Column, tokenizer: str, template: tuple[str, str] = TEMPLATE) -> Column:
    """Struct of prompt_len, raw_len and boundary_ok: tokens of the templated prompt and of prompt and answer together, and whether the first are an exact prefix of the latter, as masks by length need. Nulls count as empty."""
    path = known(tokenizer)
    schema = T.StructType([T.StructField("prompt_len", T.IntegerType()), T.StructField("raw_len", T.IntegerType()), T.StructField("boundary_ok", T.BooleanType())])

    @F.pandas_udf(schema)
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for p, c in batches:
            heads = [template[0].format(x) for x in p.fillna("")]
            a, b = encode(heads), encode([h + template[1].format(x) for h, x in zip(heads, c.fillna(""))])
            yield pd.DataFrame({"prompt_len": [len(x) for x in a], "raw_len": [len(y) for y in b], "boundary_ok": [y[: len(x)] == x for x, y in zip(a, b)]}).astype({"prompt_len": "int32", "raw_len": "int32"})

    return counted(prompt, answer)
