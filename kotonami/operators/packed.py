"""Several values packed in one field: a quote-aware finite-state tokenizer.

Every packed field becomes an array of its values in order; `unpack` gives one
row per value with its place. The automaton knows four states (before a value,
inside a plain value, inside quotes, after a closing quote) and two depths: of
brackets that wrap the list, and of brackets opened inside a value, whose
separators don't split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that separate, quote and wrap, half and full width.
SEPARATORS = ",，、､;；:：|｜¦/／\\＼\t\r\n"
QUOTES = {'"': '"', "'": "'", "＂": "＂", "＇": "＇", "“": "”", "‘": "’", "「": "」", "『": "』"}
BRACKETS = {"[": "]", "［": "］", "{": "}", "｛": "｝", "(": ")", "（": "）", "【": "】", "〔": "〕", "<": ">", "〈": "〉"}


class PackedTokenizer:
    """Split packed fields by `separators` outside quotes and inner brackets.

    - Blanks at a value's edges and marks of quotation around it are dropped.
    - A closing mark doubled within quotes stands for one.
    - A mark of quotation inside a plain value is an ordinary character (rock'n'mill).
    - An opening mark without its closing one is an ordinary character.
    - Brackets at the start of a value wrap the list; those inside a value nest.
    - Empty values are dropped and take no place; repeated values stay.
    - With `escape`, that character makes the next one ordinary, within quotes too, and separates
      nothing itself; at the end of the field it stands for itself.
    """

    def __init__(self, separators: str = SEPARATORS, quotes: dict[str, str] = QUOTES, brackets: dict[str, str] = BRACKETS, escape: str | None = None):
        self.separators, self.quotes, self.brackets, self.escape = frozenset(separators) - {escape}, dict(quotes), dict(brackets), escape
        self.closing = frozenset(brackets.values())
        special = "".join(map(re.escape, sorted(self.separators | set(brackets) | self.closing | ({escape} if escape else set()))))
        self.run = re.compile(f"[^{special}]+")
        self.until = {q: re.compile(f"[^{re.escape(q)}{re.escape(escape or '')}]+") for q in set(quotes.values())}

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        values: list[str] = []
        item: list[str] = []
        n, at, wrapped, nested = len(text), 0, 0, 0
        fresh, dead = True, set()  # fresh: no character of the value yet; dead: marks known to have no closing one
        while at < n:
            ch = text[at]
            if ch == self.escape and at + 1 < n:
                item.append(text[at + 1])
                fresh, at = False, at + 2
            elif fresh and ch not in self.separators and ch.isspace():
                at += 1
            elif fresh and ch in self.quotes and ch not in dead:
                body, end = self._quoted(text, at, self.quotes[ch])
                if end < 0:
                    dead.add(ch)
                    continue
                item.append(body)
                fresh, at = False, end
            elif ch in self.separators and not nested:
                self._emit(values, item)
                fresh, at = True, at + 1
            elif fresh and ch in self.brackets:
                wrapped, at = wrapped + 1, at + 1
            elif ch in self.closing and not nested and wrapped:
                wrapped, at = wrapped - 1, at + 1
                self._emit(values, item)
                fresh = True
            elif m := self.run.match(text, at):
                item.append(m[0])
                fresh, at = False, m.end()
            else:  # a bracket inside a value, or a separator inside such brackets
                if ch in self.brackets:
                    nested += text.find(self.brackets[ch], at) > 0
                elif ch in self.closing:
                    nested = max(0, nested - 1)
                item.append(ch)
                fresh, at = False, at + 1
        self._emit(values, item)
        return values

    def _quoted(self, text: str, at: int, close: str) -> tuple[str, int]:
        """The text within quotes from `at`, and the position after the closing mark; -1 where there is none."""
        parts, at = [], at + 1
        while at < len(text):
            if text[at] == self.escape and at + 1 < len(text):
                parts.append(text[at + 1])
                at += 2
            elif m := self.until[close].match(text, at):
                parts.append(m[0])
                at = m.end()
            elif text[at] != close:  # an escape at the end
                return "", -1
            elif text.startswith(close, at + 1):
                parts.append(close)
                at += 2
            else:
                return "".join(parts), at + 1
        return "", -1

    @staticmethod
    def _emit(values: list[str], item: list[str]) -> None:
        if value := "".join(item).strip():
            values.append(value)
        item.clear()


def packed_values(packed: Column, tokenizer: PackedTokenizer | None = None, least: int = 1) -> Column:
    """array<string> of the values in `packed`; null and empty fields, and those with fewer than `least`, give an empty array."""
    split = tokenizer or PackedTokenizer()

    @F.pandas_udf(T.ArrayType(T.StringType(), False))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            lists = [split(x) for x in batch]
            yield pd.Series([x if len(x) >= least else [] for x in lists], dtype=object)

    return run(packed)


def unpack(df: DataFrame, packed: str, keys: list[str], least: int = 1, tokenizer: PackedTokenizer | None = None) -> DataFrame:
    """One row (keys, pos, value) for each value in `packed`; `pos` counts from 1.

    Repeated rows of (keys, packed) count once; rows with different fields under one
    key all give their values. Fields with fewer than `least` values give no row.
    Other columns of `df` are left out, so their names can't clash.

    A field is tokenized where it is read, once; one shuffle, combined before it, removes copies.
    """
    narrow = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)], df[packed].alias("packed")).where("packed is not null and packed <> ''")
    rows = narrow.select(*[F.col(f"k{i}") for i in range(len(keys))], F.posexplode(packed_values(F.col("packed"), tokenizer, least)).alias("p", "value"))
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], (F.col("p") + 1).alias("pos"), "value").distinct()
