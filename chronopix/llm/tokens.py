"""Texts to token ids, in Arrow batches.

Ids are those of the `tokenizers` library for `byte_bpe_50k.json` with add_special_tokens=False and special strings taken
as ordinary text. The production engine reads the same vocabulary from `byte_bpe_50k.tiktoken`, because it makes the same
ids about five times as fast (tests compare the two); engine="tokenizers" selects the other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 0

# Fixed value: the split pattern of this byte-level vocabulary, with possessive quantifiers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, engine: str = "tiktoken") -> Callable[[str], list[int]]:
    """A function from a text to its ids; loaded once per process."""
    if (path, engine) not in _encoders:
        if engine == "tiktoken":
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
            _encoders[path, engine] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _encoders[path, engine] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _encoders[path, engine]


def document_ids(text: str | None, encode: Callable[[str], list[int]], end: int = END) -> np.ndarray:
    """A document's ids and its end id, as little-endian unsigned 32-bit integers; a null text is empty."""
    ids = encode(text) if text else []
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = end
    return out


def map_documents(
    docs: DataFrame, make: Callable[[object, np.ndarray], Iterator[tuple]], schema: str, path: str, engine: str = "tiktoken",
    id_col: str = "doc_id", text_col: str = "text", rows: int = 256,
) -> DataFrame:
    """Calls make(doc id, its ids) for every document, and returns the rows that it gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, engine)
        out: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b["id"], b["body"], strict=True):
                out.extend(make(None if doc_id is None or doc_id != doc_id else int(doc_id), document_ids(text, encode)))
                if len(out) >= rows:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(x.split() for x in schema.split(", "))
    dtypes = {"long": "Int64", "int": "Int32", "binary": object, "string": object}

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=dtypes[kinds[k]]) for i, k in enumerate(names)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInPandas(run, schema)
