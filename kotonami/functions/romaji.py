"""Romaji to kana: the table is built from rules, the conversion is one compiled pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOWELS = "aiueo"
#: Kana of each consonant with a, i, u, e, o; '.' where there is none.
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの",
    "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "y": "や.ゆ.よ", "r": "らりるれろ", "x": "ぁぃぅぇぉ", "xy": "ゃ.ゅ.ょ",
}
#: Contracted sounds, the first kana and the small kana of each vowel ('.' none, '-' nothing more).
CONTRACTED = {
    **{c + "y": (k, "ゃ.ゅ.ょ") for c, k in zip("kgnhbpmr", "きぎにひびぴみり")},
    "sy": ("し", "ゃ.ゅ.ょ"), "sh": ("し", "ゃ-ゅ.ょ"), "zy": ("じ", "ゃ.ゅぇょ"), "j": ("じ", "ゃ-ゅぇょ"), "ty": ("ち", "ゃ.ゅぇょ"), "ch": ("ち", "ゃ-ゅぇょ"),
    "dy": ("ぢ", "ゃ.ゅ.ょ"), "dh": ("で", "ゃぃゅぇょ"), "th": ("て", "ゃぃゅぇょ"), "f": ("ふ", "ぁぃ-ぇぉ"), "v": ("う゛", "ぁぃ-ぇぉ"), "ts": ("つ", "..-.."),
}
#: Single entries, symbols last.
SINGLE = {
    "xtu": "っ", "xtsu": "っ", "xwa": "ゎ", "wa": "わ", "wo": "を", "wi": "うぃ", "we": "うぇ", "n": "ん", "n'": "ん", "nn": "ん", "dyi": "でぃ", "hu": "ふ",
    "-": "ー", ".": "。", ",": "、", "[": "「", "]": "」", "z[": "『", "z]": "』", "z-": "〜", "z.": "…", "z,": "‥", "z:": "‥", "z/": "・", "zh": "←", "zj": "↓", "zk": "↑", "zl": "→",
}
#: Consonants that double before these rows.
DOUBLED = ("k", "g", "s", "z", "t", "d", "h", "b", "p", "y", "r", "ky", "gy", "sy", "sh", "zy", "j", "ty", "ch", "dy", "dh", "th", "hy", "by", "py", "ry", "f", "v", "ts")
#: What the rule of doubling would give and the table doesn't have.
NOT_DOUBLED = ("jje",)


def default_table() -> dict[str, str]:
    """The default romaji table, about 300 entries."""
    table = {c + v: k for c, row in ROWS.items() for v, k in zip(VOWELS, row) if k != "."}
    for c, (first, small) in CONTRACTED.items():
        table |= {c + v: first + s.strip("-") for v, s in zip(VOWELS, small) if s != "."}
    for c in DOUBLED:
        table |= {c[0] + c + v: "っ" + table[c + v] for v in VOWELS if c + v in table}
    return {k: v for k, v in table.items() if k not in NOT_DOUBLED} | SINGLE


def extended(parent: dict[str, str], child: dict[str, str | None]) -> dict[str, str]:
    """A table that inherits: the child's entries win, a null deletes."""
    return {k: v for k, v in (parent | child).items() if v is not None}


class Romaji:
    """Longest key first; a character that begins no key stays."""

    def __init__(self, table: dict[str, str] | None = None):
        self.table = default_table() if table is None else table
        keys = "|".join(map(re.escape, sorted(self.table, key=lambda k: (-len(k.encode()), k))))
        self.pattern = re.compile(f"({keys}|.)", re.S)
        self.last = re.compile(f"({keys}|.)$", re.S)

    def to_hiragana(self, text: str) -> str:
        lower = "".join(c.lower() if c.isascii() else c for c in text).replace("nn", "n'")
        return self.pattern.sub(lambda m: self.table.get(m[0], m[0]), lower)

    def remove_last(self, text: str) -> str:
        return self.last.sub("", text, count=1)


def to_hiragana(col: Column, table: dict[str, str] | None = None) -> Column:
    """Romaji to hiragana; null stays null."""
    romaji = Romaji(table)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(romaji.to_hiragana, na_action="ignore")

    return run(col)


def remove_last_char(col: Column, table: dict[str, str] | None = None) -> Column:
    """Delete the last romaji unit: the leftmost match at the end. JVM-side."""
    keys = sorted(default_table() if table is None else table, key=lambda k: (-len(k), k))
    return F.regexp_replace(col, "(?s)(" + "|".join(re.sub(r"([^\w])", r"\\\1", k) for k in keys) + r"|.)\z", "")


def okuri_table(spark: SparkSession):
    """(letter, kana): what an okuri letter stands for; a vowel is itself, a consonant takes each vowel."""
    table = default_table()
    rows = [(v, table[v]) for v in VOWELS] + [(c, table[c + v]) for c in "bcdfghjklmnpqrstvwxyz" for v in VOWELS if c + v in table]
    return spark.createDataFrame(rows, "letter STRING, kana STRING")
