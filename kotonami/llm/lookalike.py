"""Visually identical text with different characters: one consistent form by Viterbi search.

A value is normalised first: ignorable characters go, compatibility forms and combining marks
are composed, blanks become single plain ones. What is left can still hold look-alike letters
of another script. Each character then offers its look-alikes, and the lattice of these is
searched by Viterbi for the path that a character n-gram model likes best. The model is a
bigram over symbols, a symbol being a confusable character itself or the script of any other
one (a long mark with the script that it prolongs), so its size is fixed by the table of look-alikes; it is counted over all values of the
table, in which the dictionary's form is by far the most frequent. A reading beside the value
speaks for kana that spell it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of characters that look alike after compatibility normalization.
GROUPS = (
    "へヘ", "べベ", "ぺペ", "りリ",  # hiragana, katakana
    "カ力", "タ夕", "エ工", "ニ二", "ハ八", "ロ口", "ト卜", "チ千", "ミ三", "オ才", "ヒ匕", "ク勹", "ノ丿", "セ七", "メ乄", "サ廾", "イ亻", "ヌ又", "ム厶", "ヨ彐", "ソ〵",  # katakana, kanji
    "ー一-‐‑‒–—―−─━﹘ｰ",  # prolonged sound, kanji one, hyphens, dashes, rules
    # Latin, Greek, Cyrillic, Armenian, Cherokee
    "AΑАᎪ", "BΒВᏴ", "CСᏟ", "DᎠ", "EΕЕᎬ", "FϜ", "GᏀԌ", "HΗНᎻ", "IΙІӀ", "JЈᎫ", "KΚКᏦ", "LᏞ", "MΜМᎷ", "NΝ", "OΟОՕ", "PΡРᏢ", "QԚ", "RᎡ", "SЅՏᏚ", "TΤТᎢ", "UՍ", "VᏙѴ", "WᎳԜ", "XΧХ", "YΥУҮ", "ZΖᏃ",
    "aаɑα", "cсϲ", "dԁ", "eе", "fք", "gցɡ", "hһհ", "iіι", "jјϳ", "kкκ", "mм", "nпո", "oоοօ", "pрρ", "qԛգ", "rг", "sѕ", "tтτ", "uυս", "vνѵ", "wԝω", "xхχ", "yуγ", "lӏ",
)
#: Radicals and variants that compatibility normalization leaves, and their ordinary kanji.
PLAIN_KANJI = dict(zip("戶黑靑內敎產淸⺟⻁⻄⻑⻘⻝⻤⻨⻩⻫⻭⻯⻲⺠", "戸黒青内教産清母虎西長青食鬼麦黄斉歯竜亀民"))

_SELECTORS = f"{chr(0x34F)}{chr(0x115F)}{chr(0x1160)}{chr(0x17B4)}{chr(0x17B5)}{chr(0x180B)}-{chr(0x180F)}{chr(0x3164)}{chr(0xFE00)}-{chr(0xFE0F)}{chr(0xFFA0)}{chr(0xE0100)}-{chr(0xE01EF)}"
_FORMATS = "".join(chr(c) for a, b in ((0xAD, 0xAE), (0x61C, 0x61D), (0x180E, 0x180F), (0x200B, 0x2010), (0x202A, 0x202F), (0x2060, 0x2070), (0xFEFF, 0xFF00), (0xFFF9, 0xFFFC), (0xE0001, 0xE0080)) for c in range(a, b))
_IGNORABLE = re.compile(f"[{_SELECTORS}{re.escape(_FORMATS)}]+")
_BLANKS = re.compile(r"\s+")
_TO_HIRAGANA = {k: k - 0x60 for k in range(0x30A1, 0x30F7)}
_KANJI = str.maketrans(PLAIN_KANJI)

#: Other characters of a confusable one, itself first.
ALIKE = {ch: ch + g.replace(ch, "") for g in GROUPS for ch in g}


def script(ch: str) -> str:
    """The script of a character, by a name of several letters (so that it's no symbol of a character)."""
    o = ord(ch)
    if 0x3041 <= o <= 0x3096 or 0x309D <= o <= 0x309F:
        return "hiragana"
    if 0x30A1 <= o <= 0x30FA or 0x30FD <= o <= 0x30FF:
        return "katakana"
    if o == 0x30FC:
        return "long"
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or o >= 0x20000 or o in (0x3005, 0x3007):
        return "kanji"
    if ch.isdigit():
        return "digit"
    if ch == " ":
        return "blank"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if o < 0x250 and ch.isalpha():
        return "latin"
    return "dash" if unicodedata.category(ch) == "Pd" else "other"


KANA = frozenset(("hiragana", "katakana", "long"))


def normalized(text: str) -> str:
    """The value without ignorable characters, in composed compatibility form, with single plain blanks inside."""
    bare = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    return _BLANKS.sub(" ", _IGNORABLE.sub("", bare)).strip().translate(_KANJI)


def symbol(ch: str, before: str) -> str:
    """What the model sees of a character after the symbol `before`; the long mark keeps the script that it prolongs."""
    if ch == "ー":
        return "long " + before.removeprefix("long ") if before.startswith("long ") else "long " + ScriptModel.kind(before)
    return ch if ch in ALIKE else script(ch)


def symbols(text: str) -> list[str]:
    """The symbols of a value, with its ends."""
    out = ["^"]
    for ch in text:
        out.append(symbol(ch, out[-1]))
    out.append("$")
    return out


class ScriptModel:
    """Smoothed bigram over symbols: to the counts of a pair come `prior` counts spread by the scripts' own bigram."""

    def __init__(self, counts: dict[tuple[str, str], int], prior: float = 20.0):
        self.pairs, self.prior = counts, prior
        self.left, self.right = Counter(), Counter()
        self.by_script, self.script_left, self.script_right = Counter(), Counter(), Counter()
        for (a, b), n in counts.items():
            sa, sb = self.kind(a), self.kind(b)
            self.left[a] += n
            self.right[b] += n
            self.by_script[sa, sb] += n
            self.script_left[sa] += n
            self.script_right[sb] += n
        self.score = lru_cache(maxsize=200_000)(self._score)

    @staticmethod
    def kind(sym: str) -> str:
        return sym if sym not in ALIKE else script(sym)

    def _score(self, a: str, b: str) -> float:
        sa, sb = self.kind(a), self.kind(b)
        scripts = (self.by_script[sa, sb] + 0.05) / (self.script_left[sa] + 0.5)
        own = (self.right[b] + 0.05) / (self.script_right[sb] + 1.0)
        return log((self.pairs.get((a, b), 0) + self.prior * scripts * own) / (self.left[a] + self.prior))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "score"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.score = lru_cache(maxsize=200_000)(self._score)


class Canonical:
    """The one form of values of a field, by the model; `reading` values are hiragana."""

    def __init__(self, model: ScriptModel, bonus: float = 4.0, written: float = 0.5):
        self.model, self.bonus, self.written = model, bonus, written

    def reading(self, text: str) -> str:
        plain = normalized(text)
        if plain.startswith("__"):
            return plain
        out = []
        for ch in plain.translate(_TO_HIRAGANA):
            if script(ch) not in ("hiragana", "long", "digit"):
                ch = next((c for c in ALIKE.get(ch, "") if script(c) in ("hiragana", "long")), ch)
            out.append(ch)
        return "".join(out)

    def surface(self, text: str, reading: str | None = None) -> str:
        """Path of the lattice with the best score; of equal ones the one as written.

        `reading` is the value's reading in its form; it counts where kana of some path spell all of it.
        """
        plain = normalized(text)
        if not any(ch in ALIKE for ch in plain) or plain.startswith("__"):
            return plain
        if reading is not None and plain.translate(_TO_HIRAGANA) == reading and len({script(ch) for ch in plain} - {"long"}) == 1:
            return plain  # one kana script that spells the reading; its other kana form is another word
        choices = [ALIKE.get(ch, ch) for ch in plain]
        spelt = reading is not None and len(reading) == len(plain) and all(any(c.translate(_TO_HIRAGANA) == r for c in cs) for cs, r in zip(choices, reading))
        found = self._search(plain, choices, reading if spelt else None)
        if reading is not None and found.translate(_TO_HIRAGANA) != reading and all(script(c) in KANA for c in found):
            # kana that spell something else than the reading: where a character can be another script's, it is
            others = ["".join(c for c in cs if script(c) not in KANA) or cs for cs in choices]
            found = self._search(plain, others, None)
        return found

    def _search(self, plain: str, choices: list[str], spelling: str | None) -> str:
        """Viterbi: for every symbol that a path can end with, the best path."""
        score = self.model.score
        best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for i, cs in enumerate(choices):
            step: dict[str, tuple[float, str]] = {}
            for c in cs:
                gain = (self.written if c == plain[i] else 0.0) + (self.bonus if spelling is not None and c.translate(_TO_HIRAGANA) == spelling[i] else 0.0)
                for a, (s, path) in best.items():
                    sym = symbol(c, a)
                    if sym not in step or s + score(a, sym) + gain > step[sym][0]:
                        step[sym] = s + score(a, sym) + gain, path + c
            best = step
        return max(((s + score(a, "$"), p) for a, (s, p) in best.items()), key=lambda x: x[0])[1]


def count_symbols(batches: Iterator[pa.RecordBatch], n_fields: int) -> Iterator[pa.RecordBatch]:
    """Symbol bigrams of a partition's values; not more rows than pairs of symbols."""
    counts: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for k in range(n_fields):
            seen = batch.column(k).value_counts()
            for value, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                if value is not None and not value.startswith("__"):
                    s = symbols(normalized(value))
                    for pair in zip(s, s[1:]):
                        counts[pair] += n
    yield pa.record_batch({"a": pa.array([a for a, _ in counts], pa.string()), "b": pa.array([b for _, b in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def fit_model(df: DataFrame, fields: list[str]) -> ScriptModel:
    """The model of all values in `fields`; its bigrams, bounded by the symbols squared, come to the driver."""
    pairs = df.select(*[df[f].alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(lambda b: count_symbols(b, len(fields)), "a STRING, b STRING, n BIGINT")
    return ScriptModel({(r["a"], r["b"]): r["n"] for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).toLocalIterator()})


def canonical_values(df: DataFrame, keys: list[str], surface: str, reading: str) -> DataFrame:
    """`keys`, both fields as they are and in their one form (`surface_form`, `reading_form`); null stays null.

    Every row gives one row, repeated ones too; other columns are left out.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(fit_model(df, [surface]))
    rows = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)], df[surface].alias("surface"), df[reading].alias("reading"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Canonical(model.value)
        read = lru_cache(maxsize=100_000)(form.reading)
        write = lru_cache(maxsize=200_000)(form.surface)
        for batch in batches:
            readings = [None if r is None else read(r) for r in batch.column("reading").to_pylist()]
            surfaces = [None if s is None else write(s, r) for s, r in zip(batch.column("surface").to_pylist(), readings)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(surfaces, pa.string()), pa.array(readings, pa.string())], names=[*batch.schema.names, "surface_form", "reading_form"])

    schema = ", ".join([f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys))] + ["surface STRING, reading STRING, surface_form STRING, reading_form STRING"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "surface", "reading", "surface_form", "reading_form")
