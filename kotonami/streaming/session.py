"""Input sessions: conversion while typing, commits that teach, and the loop of keys and commands.

The relational part converts whole batches of inputs by the engine. The loop of a session is a
fold over its key events in order; sessions are independent, so each is one group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kotonami.functions.romaji import Romaji
from kotonami.functions.text import FULL_ASCII, FULL_KANA, HALF_ASCII, HALF_KANA, HALF_VOICED, HIRAGANA, KATAKANA, VOICED, dynamic_surface
from kotonami.operators import decode
from kotonami.plans.engine import Engine
from kotonami.streaming.ime import bypasses, reading
from kotonami.streaming.userdata import UserStore

PAGE = 10


# -- conversion of inputs ------------------------------------------------------------------


def henkan(engine: Engine, inputs: DataFrame) -> DataFrame:
    """Ranked candidates of inputs (sent_id, raw_input, optional force_ranges): romaji is read and converted, a bypassed input is its own only candidate."""
    ranges = F.col("force_ranges") if "force_ranges" in inputs.columns else F.lit(None).cast("array<struct<start:int,end:int>>")
    rows = inputs.where("raw_input <> ''").select("sent_id", "raw_input", ranges.alias("force_ranges"))
    by = bypasses(F.col("raw_input"), F.coalesce(F.size("force_ranges"), F.lit(0)) > 0)
    converted = engine.convert(rows.where(~by).select("sent_id", reading(F.lower("raw_input")).alias("yomi"), "force_ranges"))
    own = rows.where(by).select("sent_id", F.lit(0).alias("clause_i"), F.lit(1).alias("rank"), F.col("raw_input").alias("surface"), F.col("raw_input").alias("yomi"), F.lit(0.0).alias("cost"), F.lit(False).alias("compound_word"), F.lit(True).alias("on_path"))
    return converted.unionByName(own)


def live_texts(engine: Engine, keystrokes: DataFrame) -> DataFrame:
    """(sent_id, surface): the first conversion of what each keystroke (sent_id, raw_input) leaves in the input."""
    return decode.best_text(henkan(engine, keystrokes))


def selected(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """(commit_id, i, surface, yomi, compound_word) that commits take: the chosen candidate (sent_id, clause_i, rank) of a clause, else its first."""
    wanted = choices.select("sent_id", "clause_i", F.col("rank").alias("_rank"))
    rows = candidates.join(wanted, ["sent_id", "clause_i"], "left").where(F.col("rank") == F.coalesce("_rank", F.lit(1)))
    return rows.select(F.col("sent_id").alias("commit_id"), F.col("clause_i").alias("i"), "surface", "yomi", "compound_word")


def committed_text(commits: DataFrame, now: Column) -> DataFrame:
    """(commit_id, text): the candidates of a commit joined, those that are made at conversion with their value at `now`."""
    lists = commits.groupBy("commit_id").agg(F.sort_array(F.collect_list(F.struct("i", dynamic_surface(F.col("surface"), F.col("yomi"), now).alias("s")))).alias("c"))
    return lists.select("commit_id", F.array_join(F.transform("c", lambda x: x["s"]), "").alias("text"))


def live_stream(engine: Engine, keystrokes: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Convert a stream of keystrokes (sent_id, raw_input), batch by batch, into (sent_id, surface) under `path`."""

    def convert(batch: DataFrame, epoch: int) -> None:
        live_texts(engine, batch).write.mode("overwrite").parquet(f"{path}/texts/epoch={epoch}")

    writer = keystrokes.writeStream.foreachBatch(convert).option("checkpointLocation", f"{path}/state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def commit_stream(engine: Callable[[], Engine], commits: DataFrame, store: UserStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Learn from a stream of commits (sent_id, raw_input, choices array<struct<clause_i, rank>>): convert, take what was chosen, record it.

    `engine` is asked anew for each batch, so that one which reads the store converts by what was learned.
    """

    def learn(batch: DataFrame, epoch: int) -> None:
        choices = batch.select("sent_id", F.explode("choices").alias("c")).select("sent_id", "c.clause_i", "c.rank")
        store.record(selected(henkan(engine(), batch), choices), epoch)

    writer = commits.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# -- the loop of a session -----------------------------------------------------------------

#: A conversion: of a reading and forced ranges, the clauses, each with its candidates (surface, yomi, compound).
Converter = Callable[[str, list[tuple[int, int]]], list[list[tuple[str, str, bool]]]]
_KATA = str.maketrans(HIRAGANA, KATAKANA)
_FULL = str.maketrans(" " + HALF_ASCII, chr(0x3000) + FULL_ASCII)
_HALF = str.maketrans({**dict(zip(FULL_KANA, HALF_KANA)), **{v: HALF_KANA[FULL_KANA.index(p)] + "ﾞ" for p, v in zip(*VOICED)}, **{v: HALF_KANA[FULL_KANA.index(p)] + "ﾟ" for p, v in zip(*HALF_VOICED)}})
_DIRECT = {
    "convert_to_full_hiragana": lambda raw, kana: kana, "convert_to_full_katakana": lambda raw, kana: kana.translate(_KATA), "convert_to_half_katakana": lambda raw, kana: kana.translate(_KATA).translate(_HALF),
    "convert_to_full_romaji": lambda raw, kana: raw.translate(_FULL), "convert_to_half_romaji": lambda raw, kana: raw,
}
MODES = {"set_input_mode_hiragana": "hiragana", "set_input_mode_alnum": "alnum", "set_input_mode_fullwidth_alnum": "fullwidth_alnum", "set_input_mode_katakana": "katakana", "set_input_mode_halfwidth_katakana": "half_katakana"}
COMMANDS = (
    *MODES, *_DIRECT, "commit_candidate", "commit_preedit", "escape", "page_up", "page_down", "update_candidates", "erase_character_before_cursor",
    "cursor_up", "cursor_down", "cursor_right", "cursor_left", "extend_clause_right", "extend_clause_left", *(f"press_number_{n}" for n in range(10)),
)


@dataclass(frozen=True)
class Session:
    """What one input holds: raw input, mode, clauses with their candidates, the chosen ones, the focused clause."""

    raw: str = ""
    mode: str = "hiragana"
    clauses: tuple = ()
    chosen: tuple[int, ...] = ()
    focus: int = 0
    commits: tuple = field(default=(), compare=False)

    @property
    def state(self) -> str:
        return "PreComposition" if not self.raw else "Conversion" if self.clauses else "Composition"

    def text(self) -> str:
        return "".join(c[k][0] for c, k in zip(self.clauses, self.chosen))


class Loop:
    """Carries out commands and keys on sessions; a command that doesn't apply leaves the key to others."""

    def __init__(self, convert: Converter, romaji: Romaji | None = None):
        self.convert, self.romaji = convert, romaji or Romaji()

    def _kana(self, s: Session) -> str:
        return self.romaji.to_hiragana(s.raw)

    def _shown(self, s: Session) -> str:
        """The preedit as it is committed: whole kana of the input mode."""
        if s.raw[:1].isupper():
            return s.raw
        kana = self._kana(s)
        return {"katakana": kana.translate(_KATA), "half_katakana": kana.translate(_KATA).translate(_HALF), "alnum": s.raw, "fullwidth_alnum": s.raw.translate(_FULL)}.get(s.mode, kana)

    def _converted(self, s: Session, ranges: list[tuple[int, int]] | None = None) -> Session:
        by = s.raw.startswith(("http://", "https://")) or (s.raw[:1].isupper() and not ranges)
        clauses = [[(s.raw, s.raw, False)]] if by else self.convert(self._kana(s), ranges or [])
        return replace(s, clauses=tuple(map(tuple, clauses)), chosen=(0,) * len(clauses), focus=min(s.focus, max(len(clauses) - 1, 0)))

    def _done(self, s: Session, text: str, learned: tuple = ()) -> Session:
        return Session(mode=s.mode, commits=(*s.commits, (text, learned)))

    def _ranges(self, s: Session, move: int) -> list[tuple[int, int]]:
        """Ranges of the clauses after the border of the focused one has moved by a character."""
        lengths = [len(c[0][1]) for c in s.clauses]
        f = s.focus
        if move > 0:
            if f + 1 < len(lengths):
                lengths[f : f + 2] = [lengths[f] + 1, lengths[f + 1] - 1]
        elif len(lengths) == 1 or f == 0:
            if lengths[f] > 1:
                lengths[f : f + 2] = [lengths[f] - 1, (lengths[f + 1] if f + 1 < len(lengths) else 0) + 1]
        else:
            lengths[f - 1 : f + 1] = [lengths[f - 1] - 1, lengths[f] + 1]
        out, at = [], 0
        for n in lengths:
            if n:
                out.append((at, at + n))
                at += n
        return out

    def command(self, s: Session, name: str) -> Session | None:
        """The session after a command; null where the command doesn't apply."""
        if name not in COMMANDS:
            raise ValueError(f"unknown command: {name}")
        if name in MODES:
            s = self._done(s, self._shown(s)) if s.raw else s
            return replace(s, mode=MODES[name])
        if name in _DIRECT:
            kana = self._kana(s)
            return replace(s, clauses=(((_DIRECT[name](s.raw, kana), kana, False),),), chosen=(0,), focus=0) if s.raw else s
        if name == "commit_candidate":
            return self._done(s, s.text(), tuple(c[k] for c, k in zip(s.clauses, s.chosen)))
        if name == "commit_preedit":
            return self._done(s, self._shown(s)) if s.raw else s
        if name == "escape":
            return replace(s, clauses=(), chosen=(), focus=0) if s.clauses else Session(mode=s.mode, commits=s.commits)
        if name == "update_candidates":
            return self._converted(s)
        if name == "erase_character_before_cursor":
            return replace(s, clauses=(), chosen=(), focus=0) if s.clauses else replace(s, raw=self.romaji.remove_last(s.raw))
        if not s.clauses:
            return None if name.startswith("press_number") else s
        if name in ("extend_clause_right", "extend_clause_left"):
            return self._converted(s, self._ranges(s, 1 if name.endswith("right") else -1))
        if name in ("cursor_right", "cursor_left"):
            return replace(s, focus=(s.focus + (1 if name.endswith("right") else -1)) % len(s.clauses))
        n, k = len(s.clauses[s.focus]), s.chosen[s.focus]
        if name in ("cursor_down", "cursor_up"):
            k = (k + (1 if name.endswith("down") else -1)) % n
        elif name in ("page_down", "page_up"):
            to = k // PAGE + (1 if name.endswith("down") else -1)
            k = min(to * PAGE + k % PAGE, n - 1) if 0 <= to <= (n - 1) // PAGE else k
        else:
            digit = int(name[-1])
            to = k // PAGE * PAGE + (digit - 1) % PAGE
            if to >= n:
                return None
            k = to
        return replace(s, chosen=(*s.chosen[: s.focus], k, *s.chosen[s.focus + 1 :]))

    def key(self, s: Session, command: str | None, char: str, modified: bool = False) -> tuple[Session, bool]:
        """The session after a key event, and whether the key was used: its command first, else the character goes into the input."""
        if command is not None and (after := self.command(s, command)) is not None:
            return after, True
        if modified or not (len(char) == 1 and "!" <= char <= "~") or s.mode == "alnum":
            return s, False
        if s.mode == "fullwidth_alnum":
            return replace(s, commits=(*s.commits, (char.translate(_FULL), ()))), True
        if s.clauses:  # a new character settles the conversion
            s = self.command(s, "commit_candidate")
        return replace(s, raw=s.raw + char), True


def run_sessions(events: DataFrame, convert: Converter) -> DataFrame:
    """(session_id, n, text): what the sessions of events (session_id, seq, command, char, modified) commit, in order.

    A session's events are one group; a user's own keystrokes bound its size.
    """
    kind = events.schema["session_id"].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        loop, s = Loop(convert), Session()
        for command, char, modified in zip(*(pdf.sort_values("seq")[c] for c in ("command", "char", "modified"))):
            s, _ = loop.key(s, command if isinstance(command, str) else None, char if isinstance(char, str) else "", bool(modified))
        return pd.DataFrame([(pdf.session_id.iat[0], n, t) for n, (t, _) in enumerate(s.commits)], columns=["session_id", "n", "text"])

    return events.groupBy("session_id").applyInPandas(fold, f"session_id {kind}, n INT, text STRING")


def by_dictionary(words: dict[str, list[str]]) -> Converter:
    """A converter of forced or whole ranges by a small dictionary: its candidates, then the reading and its katakana."""

    def convert(kana: str, ranges: list[tuple[int, int]]) -> list[list[tuple[str, str, bool]]]:
        parts = [kana[a:b] for a, b in ranges] or [kana]
        return [[(c, p, False) for c in dict.fromkeys([*words.get(p, ()), p, p.translate(_KATA)])] for p in parts if p]

    return convert
