"""The tokenizer budgets are counted with, and whether it's the one that was wanted.

A vocabulary file makes the exact one; without it the pattern of `text.PIECE` stands in, and says so.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X


@dataclass(frozen=True)
class Tokenizer:
    name: str
    degraded: bool
    detail: str = ""
    path: str | None = None

    def count(self, text: Column) -> Column:
        """The number of tokens of a text column."""
        if self.path is None:
            return X.count_tokens(text)
        where = self.path

        @F.pandas_udf("int")
        def run(texts: pd.Series) -> pd.Series:
            t = _loaded(where)
            return texts.map(lambda x: len(t.encode(x or "", add_special_tokens=False).ids)).astype("int32")

        return run(text)

    def truncate(self, text: Column, keep: int) -> Column:
        """The first `keep` tokens as text."""
        if self.path is None:
            return X.truncate_tokens(text, keep)
        where = self.path

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            t = _loaded(where)
            return texts.map(lambda x: t.decode(t.encode(x or "", add_special_tokens=False).ids[:keep], skip_special_tokens=False))

        return run(text)


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


def get_tokenizer(path: str | None = None) -> Tokenizer:
    """The tokenizer of a vocabulary file (or of $LODESTONE_TOKENIZER), else the fallback with the reason."""
    path = path or os.environ.get("LODESTONE_TOKENIZER")
    if not path:
        return Tokenizer("pieces", True, "no vocabulary file was given")
    try:
        _loaded(path)
    except Exception as e:  # noqa: BLE001
        return Tokenizer("pieces", True, f"{path} can't be used: {type(e).__name__}")
    return Tokenizer(os.path.basename(path), False, path=path)
