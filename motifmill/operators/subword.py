"""Subword pieces of a public SentencePiece model (its path is a parameter; none is trained here)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Subwords:
    def __init__(self, path: str):
        self.path = path

    def _load(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @property
    def vocab_size(self) -> int:
        return self._load().get_piece_size()

    def _map(self, kind: str, call) -> object:
        load = self._load
        state = []

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            if not state:
                state.append(load())
            return s.map(lambda x: None if x is None else call(state[0], x))

        return run

    def pieces(self, col: Column) -> Column:
        return self._map("array<string>", lambda m, x: m.encode(x, out_type=str))(col)

    def ids(self, col: Column, bos: bool = False, eos: bool = False) -> Column:
        return self._map("array<int>", lambda m, x: m.encode(x, add_bos=bos, add_eos=eos))(col)

    def text(self, col: Column) -> Column:
        return self._map("string", lambda m, x: m.decode([int(i) for i in x]))(col)
