"""Scalar text functions as Column expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HALF_ASCII = "".join(map(chr, range(0x21, 0x7F)))
FULL_ASCII = "".join(map(chr, range(0xFF01, 0xFF5F)))
#: Half-width katakana in code order and their full-width forms; voiced and half-voiced rows.
HALF_KANA = "".join(map(chr, range(0xFF61, 0xFFA0)))
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
VOICED = ("カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ")
HALF_VOICED = ("ハヒフヘホ", "パピプペポ")


def hira2kata(col: Column) -> Column:
    return F.translate(col, HIRAGANA, KATAKANA)


def kata2hira(col: Column) -> Column:
    return F.translate(col, KATAKANA, HIRAGANA)


def full_ascii(col: Column) -> Column:
    """Half-width ASCII to full width, blanks too."""
    return F.translate(col, " " + HALF_ASCII, chr(0x3000) + FULL_ASCII)


def half_ascii(col: Column) -> Column:
    return F.translate(col, chr(0x3000) + FULL_ASCII, " " + HALF_ASCII)


def half_kana(col: Column) -> Column:
    """Full-width katakana to half width; voiced kana become two characters."""
    plain, voiced = VOICED
    for a, b in zip(voiced, plain):
        col = F.replace(col, F.lit(a), F.lit(b + "゛"))
    for a, b in zip(HALF_VOICED[1], HALF_VOICED[0]):
        col = F.replace(col, F.lit(a), F.lit(b + "゜"))
    return F.translate(col, FULL_KANA, HALF_KANA)


def full_kana(col: Column) -> Column:
    """Half-width katakana to full width; a kana and its voicing mark become one character."""
    col = F.translate(col, HALF_KANA, FULL_KANA)
    for marks, mark in ((VOICED, "゛"), (HALF_VOICED, "゜")):
        for a, b in zip(*marks):
            col = F.replace(col, F.lit(a + mark), F.lit(b))
    return col


def trim_unicode(col: Column) -> Column:
    """Strip all Unicode white space from both ends (F.trim knows blanks only)."""
    blank = r"[\p{Z}\x09-\x0d\x{85}]"
    return F.regexp_replace(col, rf"\A{blank}++|{blank}++\z", "")


def strip_readings(col: Column) -> Column:
    """Drop readings in brackets behind a word."""
    return F.regexp_replace(col, "[（(][ぁ-ゟ、]+[）)]", "")


def strip_ruby(col: Column) -> Column:
    return F.regexp_replace(col, "《.*?》", "")


def strip_notes(col: Column) -> Column:
    """Drop transcriber's notes, from the first opening to the last closing one of a line."""
    return F.regexp_replace(col, "［＃.*］", "")


def strip_meta(col: Column) -> Column:
    """Keep what stands between the last line of hyphens and the colophon."""
    return F.regexp_replace(F.regexp_replace(col, r"(?s)\A.*-{10,}\r?\n", ""), "(?s)底本：.*", "")


def is_kyukana(col: Column) -> Column:
    """Whether the text uses kana of the old orthography."""
    return col.rlike("[ゐヰゑヱ]")


def word_key(surface: Column, yomi: Column) -> Column:
    return F.concat_ws("/", surface, yomi)


def segment_number(col: Column) -> Column:
    """The number at the beginning of a reading; '' where there is none."""
    return F.regexp_extract(col, r"\A((?:0|[1-9][0-9]*)(?:\.[0-9]*)?)", 1)


#: Letters that wait for a vowel, in alphabetical order, and endings that are settled.
WAITING = "bcdfghjklmnpqrstvwxyz"
SETTLED = r"(?:nn|z[hjkl\[\]\-.,/])"


def consonant_suffix(col: Column) -> Column:
    """struct(preedit, suffix): the consonants that still wait for a vowel."""
    settled = col.rlike(SETTLED + r"\z")
    pattern = rf"\A(.*?(?:nn)*)([{WAITING}]+)\z"
    hit = ~settled & col.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(col, pattern, 1)).otherwise(col).alias("preedit"), F.when(hit, F.regexp_extract(col, pattern, 2)).otherwise(F.lit("")).alias("suffix"))


#: Digits, places within four, and names of groups of four.
DIGITS = "零一二三四五六七八九"
PLACES = ("", "十", "百", "千")
GROUPS = ("", "万", "億", "兆", "京")


def kansuji(col: Column) -> Column:
    """A BIGINT in kanji: groups of four places, no 一 before 十 百 千, groups of zeros left out; negatives after マイナス."""
    digits = F.lpad(F.abs(col).cast("decimal(20,0)").cast("string"), 20, "0")

    def place(g: int, p: int) -> Column:
        d = F.substring(digits, (4 - g) * 4 + (3 - p) + 1, 1)
        name = F.translate(d, "0123456789", DIGITS)
        if p:
            return F.when(d == "0", "").when(d == "1", PLACES[p]).otherwise(F.concat(name, F.lit(PLACES[p])))
        return F.when(d == "0", "").otherwise(name)

    parts = []
    for g in range(4, -1, -1):
        four = F.concat(*[place(g, p) for p in range(3, -1, -1)])
        parts.append(F.when(F.substring(digits, (4 - g) * 4 + 1, 4) == "0000", "").otherwise(F.concat(four, F.lit(GROUPS[g]))))
    return F.when(col == 0, "零").otherwise(F.concat(F.when(col < 0, "マイナス").otherwise(""), *parts))


def dynamic_surface(surface: Column, yomi: Column, now: Column) -> Column:
    """Surfaces that are made at conversion: dates, the time, numbers in kanji; others as they are.

    A reading that is no whole number gives itself in place of a number; an unknown dynamic
    surface gives its name with a notice.
    """
    head = "(*(*("
    return (
        F.when(surface == head + "TODAY-HYPHEN", F.date_format(now, "yyyy-MM-dd"))
        .when(surface == head + "TODAY-SLASH", F.date_format(now, "yyyy/MM/dd"))
        .when(surface == head + "TODAY-KANJI", F.date_format(now, "yyyy年MM月dd日"))
        .when(surface == head + "NOW-KANJI", F.date_format(now, "HH時mm分"))
        .when(surface == head + "NUMBER-KANSUJI", F.coalesce(kansuji(yomi.try_cast("bigint")), yomi))
        .when(surface.startswith(head), F.concat(F.lit("不明な動的変換: "), surface))
        .otherwise(surface)
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of characters; one row of the table as state of a nested fold."""
    left, right = F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.transform(F.concat(F.array(F.lit("")), right), lambda _: F.lit(0))

    def row(before: Column, ch: Column) -> Column:
        cells = F.zip_with(right, F.arrays_zip(F.slice(before, 1, F.size(right)).alias("d"), F.slice(before, 2, F.size(right)).alias("u")), lambda r, x: F.struct(r.alias("r"), x["d"].alias("d"), x["u"].alias("u")))
        return F.aggregate(cells, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.greatest(F.when(c["r"] == ch, c["d"] + 1).otherwise(0), c["u"], F.element_at(acc, -1)))))

    return F.when(a.isNull() | b.isNull(), None).when((F.size(left) == 0) | (F.size(right) == 0), 0).otherwise(F.element_at(F.aggregate(left, zero, row), -1))


def mecab_features(feature: Column, surface: Column) -> Column:
    """struct(hinshi, subhinshi, subsubhinshi, yomi) of a comma-separated feature field."""
    f = F.split(feature, ",", -1)
    n = F.size(f)
    return F.struct(
        F.get(f, F.lit(0)).alias("hinshi"),
        F.when(n > 2, F.get(f, F.lit(1))).otherwise("UNK").alias("subhinshi"),
        F.when(n > 3, F.get(f, F.lit(2))).otherwise("UNK").alias("subsubhinshi"),
        kata2hira(F.when(n > 7, F.get(f, F.lit(7))).otherwise(surface)).alias("yomi"),
    )


def key_chord(col: Column) -> Column:
    """struct(ctrl, shift, key); a modifier other than C and S is an error."""
    parts = F.split(col, "-", -1)
    mods = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.exists(mods, lambda m: ~m.isin("C", "S"))
    return F.when(bad, F.raise_error(F.concat(F.lit("unknown modifier: "), col)).cast("struct<ctrl:boolean,shift:boolean,key:string>")).otherwise(
        F.struct(F.array_contains(mods, "C").alias("ctrl"), F.array_contains(mods, "S").alias("shift"), F.element_at(parts, -1).alias("key"))
    )


def choice(col: Column, allowed: list[str]) -> Column:
    """The value, if allowed; else an error that names it."""
    return F.when(col.isin(*allowed), col).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(col, F.lit("null")))).cast("string"))
