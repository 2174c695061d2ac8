"""Input states as stateless expressions over rows of a session: states, keys and what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonami.functions.romaji import to_hiragana
from kotonami.functions.text import consonant_suffix, full_ascii, half_kana, hira2kata, key_chord

STATES = ("PreComposition", "Composition", "Conversion")


def input_state(raw_input: Column, clause_count: Column) -> Column:
    """The state that the input and its clauses imply."""
    return F.when(raw_input == "", STATES[0]).when(clause_count > 0, STATES[2]).otherwise(STATES[1])


def bypasses(raw_input: Column, forced: Column | None = None) -> Column:
    """Whether the input stays as it is: an address, or a capital at the beginning and no forced ranges."""
    capital = raw_input.rlike("^[A-Z]")
    return raw_input.rlike("^https?://") | (capital if forced is None else capital & ~forced)


def reading(raw_input: Column) -> Column:
    """What is to be converted: hiragana, or the input itself where it is bypassed."""
    return F.when(bypasses(raw_input), raw_input).otherwise(to_hiragana(raw_input))


def preedit(raw_input: Column, mode: Column, default_table: bool = True) -> Column:
    """What is shown while typing, in input mode hiragana, katakana, half_katakana, alnum or fullwidth_alnum."""
    parts = consonant_suffix(raw_input)
    kana = F.concat(to_hiragana(parts["preedit"]), parts["suffix"]) if default_table else to_hiragana(raw_input)
    shown = F.when(mode == "katakana", hira2kata(kana)).when(mode == "half_katakana", half_kana(hira2kata(kana))).when(mode == "alnum", raw_input).when(mode == "fullwidth_alnum", full_ascii(raw_input)).otherwise(kana)
    return F.when(raw_input.rlike("^[A-Z]"), raw_input).otherwise(shown)


def direct_conversion(raw_input: Column, kind: Column) -> Column:
    """The single candidate of a direct conversion: hiragana, katakana, half_katakana, full_romaji or half_romaji."""
    kana = to_hiragana(raw_input)
    return F.when(kind == "hiragana", kana).when(kind == "katakana", hira2kata(kana)).when(kind == "half_katakana", half_kana(hira2kata(kana))).when(kind == "full_romaji", full_ascii(raw_input)).when(kind == "half_romaji", raw_input)


def key_table(bindings: DataFrame) -> DataFrame:
    """(state, ctrl, shift, key, command) of bindings (states, keys, command)."""
    each = bindings.select(F.explode("states").alias("state"), "keys", "command").select("state", F.explode("keys").alias("chord"), "command")
    return each.withColumn("k", key_chord(F.col("chord"))).select("state", "k.ctrl", "k.shift", "k.key", "command")


def extended_keys(parent: DataFrame, child: DataFrame) -> DataFrame:
    """A key table that inherits: the child's commands win, a null command deletes."""
    on = ["state", "ctrl", "shift", "key"]
    both = parent.withColumnRenamed("command", "p").join(child.select(*on, F.col("command").alias("c"), F.lit(True).alias("has")), on, "full")
    return both.select(*on, F.when(F.col("has"), F.col("c")).otherwise(F.col("p")).alias("command")).where("command is not null")


def dispatched(events: DataFrame, table: DataFrame) -> DataFrame:
    """Key events (state, ctrl, shift, key, ...) with their command; null where no binding fits."""
    return events.join(F.broadcast(table), ["state", "ctrl", "shift", "key"], "left")
