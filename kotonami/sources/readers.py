"""Text sources: wiki extracts, novels, dictionaries, annotated and evaluation corpora."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.functions.text import is_kyukana, strip_meta, strip_notes, strip_readings, strip_ruby, trim_unicode
from kotonami.functions.romaji import default_table, extended
from kotonami.operators.dictionary import expand_okuri, merge_dictionaries, parse_lines
from kotonami.runtime import Folder
from kotonami.sources import yaml
from kotonami.streaming.ime import extended_keys, key_table

#: What makes a novel file unfit, and where its text ends.
UNFIT = "二倍の踊り字|第3水準|creativecommons\\.org|旧字、旧仮名で書かれた作品を、現代表記にあらためる際の作業指針"
COLOPHON = "底本："
ALNUM = "^[a-zA-Z0-9|=-]+"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files under a folder; hidden ones and markers are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def wiki_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """`lines` that are text, trimmed and without readings; tags, markup and lines that begin with a letter or digit go.

    Lines are rows; other columns stay. Null and empty lines give nothing, nor what is empty without its readings.
    """
    t = lines.withColumn(line, trim_unicode(F.col(line)))
    kept = t.where(~F.col(line).rlike(r"^(?:<|&lt;|!|$)") & ~F.col(line).rlike(ALNUM))
    return kept.withColumn(line, strip_readings(F.col(line))).where(F.col(line) != "")


def novel_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, line) of novels (path, text): unfit files go whole, then notes, ruby and the colophon.

    A text is cut at its last line of hyphens and at its colophon before it becomes lines.
    """
    body = files.select(F.col(path).alias("path"), F.regexp_replace(text, "\r", "").alias("t"))
    fit = body.where(~F.col("path").contains("_ruby_") & ~F.col("t").rlike(UNFIT) & ~is_kyukana(F.col("t")))
    rows = fit.select("path", F.posexplode(F.split(strip_meta(F.col("t")), "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("line", trim_unicode(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(ALNUM))
    return rows.withColumn("line", strip_notes(strip_ruby(F.col("line")))).where("line <> ''")


def read_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line) of extracted wiki text."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return wiki_lines(raw)


def read_novels(spark: SparkSession, folder: str, charset: str = "Shift_JIS") -> DataFrame:
    """(path, line_no, line) of novels in files of `charset`."""
    return novel_lines(decoded_files(spark, folder, charset))


def decoded_files(spark: SparkSession, folder: str, charset: str) -> DataFrame:
    """(path, text) of whole files; bytes that `charset` lacks become U+FFFD."""
    codec = charset

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(codec, "replace"))

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", text("content").alias("text"))


#: Readers by name; `register` adds one.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"jawiki": read_wiki, "aozora_bunko": read_novels}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def read_corpus(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown corpus kind: {kind}")
    return READERS[kind](spark, folder)


def read_skk(spark: SparkSession, path: str, charset: str = "UTF-8", src_rank: int = 0) -> DataFrame:
    """(yomi, surfaces) of a dictionary file: okuri entries spelled out, then merged with the plain ones."""
    lines = decoded_files(spark, path, charset).select(F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "line")).withColumn("src_rank", F.lit(src_rank))
    parsed = parse_lines(lines)
    ari = expand_okuri(parsed.where("section = 'ari'").select("yomi", "surfaces"))
    return merge_dictionaries([ari, parsed.where("section = 'nasi'").select("yomi", "surfaces")])


def read_dictionaries(spark: SparkSession, configs: list[dict], usage: str = "Normal") -> DataFrame:
    """The dictionaries of one usage, merged in order; files that can't be found are left out.

    A config has path, encoding, dict_type and usage, spelled in any case.
    """
    loaded = []
    for rank, c in enumerate(configs):
        if (c.get("usage") or "Disabled").strip().lower() != usage.lower():
            continue
        if (c.get("dict_type") or "SKK").strip().upper() != "SKK":
            raise ValueError(f"unknown dictionary type: {c['dict_type']}")
        if Folder(spark, c["path"]).matching():
            loaded.append(read_skk(spark, c["path"], charset(c.get("encoding")), rank))
    return merge_dictionaries(loaded) if loaded else spark.createDataFrame([], "yomi STRING, surfaces ARRAY<STRING>")


def charset(name: str | None) -> str:
    """The charset of a configured name: euc-jp, EucJp, UTF-8 ...; UTF-8 for none."""
    plain = re.sub(r"[^a-z0-9]", "", (name or "utf8").lower())
    known = {"utf8": "UTF-8", "eucjp": "EUC-JP", "shiftjis": "Shift_JIS", "sjis": "Shift_JIS"}
    if plain not in known:
        raise ValueError(f"unknown encoding: {name}")
    return known[plain]


def cached_dictionary(spark: SparkSession, cache: str, configs: list[dict], usage: str = "Normal") -> DataFrame:
    """read_dictionaries, kept under `cache` until a file or the configuration changes."""
    stamp = [(Folder(spark, c["path"]).matching(), sorted((k, str(v)) for k, v in c.items())) for c in configs]
    at = f"{cache.rstrip('/')}/{hashlib.sha256(repr((usage, stamp)).encode()).hexdigest()[:24]}"
    if not Folder(spark, at).exists("_SUCCESS"):
        read_dictionaries(spark, configs, usage).write.mode("overwrite").parquet(at)
    return spark.read.schema("yomi STRING, surfaces ARRAY<STRING>").parquet(at)


def parse_table(text: str) -> tuple[str | None, dict[str, str | None]]:
    """(parent, mapping) of a romaji table in YAML: `extends`, and a `mapping` in which null deletes."""
    raw = yaml.load(text) or {}
    return raw.get("extends"), {str(k): None if v is None else str(v) for k, v in (raw.get("mapping") or {}).items()}


def load_table(spark: SparkSession, path: str) -> dict[str, str]:
    """A romaji table with all that it inherits, from files beside it; a parent that has no file is the default table."""
    folder, name = path.rsplit("/", 1)
    parent, mapping = parse_table(_text(spark, folder, name))
    if parent is None:
        return extended({}, mapping)
    beside = f"{parent}.yml"
    return extended(load_table(spark, f"{folder}/{beside}") if Folder(spark, folder).exists(beside) else default_table(), mapping)


def parse_keymap(text: str) -> tuple[str | None, list[tuple[list[str], list[str], str | None]]]:
    """(parent, bindings of states, keys and command) of a keymap in YAML; a null command deletes. Keys may be `key` or `keys`, one or a list."""
    raw = yaml.load(text) or {}
    several = lambda x: x if isinstance(x, list) else [x]
    return raw.get("extends"), [(several(b["states"]), [str(k) for k in several(b["key"])], b.get("command")) for b in raw.get("keys") or []]


def load_keymap(spark: SparkSession, path: str) -> DataFrame:
    """(state, ctrl, shift, key, command) of a keymap file and all that it inherits, from files beside it."""
    folder, name = path.rsplit("/", 1)
    parent, bindings = parse_keymap(_text(spark, folder, name))
    own = key_table(spark.createDataFrame(bindings, "states ARRAY<STRING>, keys ARRAY<STRING>, command STRING"))
    return extended_keys(load_keymap(spark, f"{folder}/{parent}.yml"), own) if parent else own.where("command is not null")


def _text(spark: SparkSession, folder: str, name: str) -> str:
    text = Folder(spark, folder).read(name)
    if text is None:
        raise FileNotFoundError(f"{folder}/{name}")
    return text


def read_corpora(spark: SparkSession, parts: list[tuple[str, str]]) -> DataFrame:
    """(kind, path, line) of several corpora (kind, folder), one after the other."""
    rows = [read_corpus(spark, kind, folder).select(F.lit(kind).alias("kind"), "path", "line") for kind, folder in parts]
    return reduce(DataFrame.unionByName, rows)
