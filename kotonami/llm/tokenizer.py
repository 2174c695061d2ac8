"""Encoding of a corpus with a public byte-level BPE: merges as a lazily determinised transducer.

Byte-pair encoding by merge ranks has a local form: a sequence of tokens is the encoding of
its text if and only if every two neighbours are what the encoding of their joined text
gives. So each prefix of a word has one last token, and the encodings of all prefixes form a
tree. Of that tree only the prefixes from which a vocabulary token might still reach beyond
the text read so far are alive; what their paths share is settled and can be emitted.

The transducer's state is (last settled token, pending bytes); its moves, on one byte or on
one whole character, are found when first needed and kept. The pending bytes are shorter
than the longest vocabulary token, which bounds the lookahead. Decoding is a stream: an
incremental UTF-8 automaton gives the text of ids as they come.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pattern of words of this family of tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class BpeTransducer:
    """Encoder and decoder of one vocabulary of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = 1_000_000):
        self.ranks, self.words, self.keep = ranks, regex.compile(pattern), keep
        self.text_of = {v: k for k, v in ranks.items()}
        self.proper = {token[:n] for token in ranks for n in range(1, len(token))}  # prefixes that a longer token has
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.keys: list[tuple[int, bytes]] = [(-1, b"")]
        self.trees: list[list[tuple[int, int] | None]] = [[(-1, -1)]]  # by state: the last token of each prefix of its pending bytes
        self.byte_moves: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}
        self.moves: list[dict[str, tuple[int, tuple[int, ...], dict]]] = [{}]  # by state: character -> state, ids, that state's moves
        self.n_moves = 0
        self.ends: dict[int, tuple[int, ...]] = {}
        self.short: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def from_file(path: str, pattern: str = PATTERN) -> BpeTransducer:
        with open(path, "rb") as f:
            return BpeTransducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # -- what the merges say ------------------------------------------------------------

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a short text by merging, lowest rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if a < 0:
            return True
        if (known := self.pairs.get((a, b))) is None:
            known = self.pairs[a, b] = self.merged(self.text_of[a] + self.text_of[b]) == [a, b]
        return known

    def _last(self, pending: bytes, tree: list[tuple[int, int] | None]) -> tuple[int, int] | None:
        """(start, token) of the last token of `pending`, given those of its shorter prefixes.

        None where that token would begin before `pending`; no longer token reaches on from such a prefix.
        """
        for start in range(len(pending)):  # the longest first
            if tree[start] is not None:
                token = self.ranks.get(pending[start:])
                if token is not None and self.fits(tree[start][1], token) and self._whole(token):
                    return start, token
        return None

    @functools.lru_cache(maxsize=None)  # noqa: B019 - one object lives as long as its worker
    def _whole(self, token: int) -> bool:
        """Whether merging the token's own text gives the token; others are never reached."""
        return self.merged(self.text_of[token]) == [token]

    # -- the transducer -----------------------------------------------------------------

    def _state(self, last: int, pending: bytes, tree: list[tuple[int, int] | None], settled: int) -> int:
        """The state of the bytes of `pending` after `settled`, with what is known of their prefixes."""
        key = last, pending[settled:]
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.trees.append([(-1, last)] + [(t[0] - settled, t[1]) if t is not None and t[0] >= settled else None for t in tree[settled + 1 :]])
            self.moves.append({})
        return number

    def _on_byte(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        found = self.byte_moves.get((state, byte))
        if found is None:
            last, pending = self.keys[state]
            pending += bytes((byte,))
            tree = self.trees[state] + [None]
            tree[-1] = self._last(pending, tree)
            alive = [len(pending)] + [j for j in range(len(pending)) if pending[j:] in self.proper]
            paths = []
            for j in alive:
                path = []
                while j > 0:
                    path.append(j)
                    j = tree[j][0]
                paths.append(path[::-1])
            settled = 0
            for ends in zip(*paths):
                if len(set(ends)) > 1:
                    break
                settled = ends[0]
            out, j = [], settled
            while j > 0:
                out.append(tree[j][1])
                j = tree[j][0]
            found = self.byte_moves[state, byte] = (self._state(out[0] if out else last, pending, tree, settled), tuple(out[::-1]))
        return found

    def _on_char(self, state: int, ch: str) -> tuple[int, tuple[int, ...], dict]:
        out: tuple[int, ...] = ()
        at = state
        for byte in ch.encode("utf-8", "surrogatepass"):
            at, more = self._on_byte(at, byte)
            out += more
        self.n_moves += 1
        move = self.moves[state][ch] = at, out, self.moves[at]
        return move

    def _on_end(self, state: int) -> tuple[int, ...]:
        tree, out, j = self.trees[state], [], len(self.keys[state][1])
        while j > 0:
            out.append(tree[j][1])
            j = tree[j][0]
        self.ends[state] = tuple(out[::-1])
        return self.ends[state]

    def _forget(self) -> None:
        """Drop the kept moves when they outgrow their bound; they are found again when needed."""
        self.states, self.keys, self.trees = {(-1, b""): 0}, [(-1, b"")], [[(-1, -1)]]
        self.byte_moves, self.moves, self.n_moves, self.ends, self.short, self.pairs = {}, [{}], 0, {}, {}, {}

    def word(self, word: str) -> tuple[int, ...]:
        known = self.short.get(word)
        if known is not None:
            return known
        if self.n_moves + len(self.byte_moves) + len(self.short) + len(self.pairs) > self.keep:
            self._forget()
        state, out, moves = 0, [], self.moves[0]
        for ch in word:
            move = moves.get(ch) or self._on_char(state, ch)
            state, ids, moves = move
            if ids:
                out += ids
        out += self.ends.get(state) or self._on_end(state)
        ids = tuple(out)
        if len(word) <= 12:
            self.short[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text, without special tokens; [] for null and empty texts."""
        out: list[int] = []
        if text:
            for m in self.words.finditer(text):
                out += self.word(m[0])
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, piece by piece; a character comes out once its last byte has come."""
        automaton = Utf8Stream()
        for i in ids:
            if piece := automaton.feed(self.text_of[i]):
                yield piece
        if piece := automaton.close():
            yield piece


class Utf8Stream:
    """Incremental UTF-8 automaton: bytes still missing, and the bounds of the next one; errors give U+FFFD."""

    def __init__(self) -> None:
        self.missing, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.value, self.missing, self.low, self.high = self.value << 6 | b & 0x3F, self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.missing, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.missing, self.value = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.missing, self.value = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.missing = self.missing, 0
        return "�" if left else ""


@functools.lru_cache(maxsize=4)
def transducer(path: str, pattern: str = PATTERN) -> BpeTransducer:
    """One transducer a worker process and vocabulary; its moves serve all tasks of the process."""
    return BpeTransducer.from_file(path, pattern)


def encode_texts(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row of `df`: the whole text as ids, an empty list for null and empty texts.

    Rows stay rows (repeated keys too); there is no shuffle.
    The vocabulary file must lie at `path` on every executor, as the cluster's image has it.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(path).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch({"key": batch.column("key"), "ids": ids})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids ARRAY<INT>").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text) of rows of ids, by the streaming decoder."""
    rows = df.select(df[key].alias("key"), df[ids].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = transducer(path).decode
        for batch in batches:
            texts = [None if x is None else "".join(decode(x)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"key": batch.column("key"), "text": pa.array(texts, pa.string())})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text STRING").withColumnRenamed("key", key)
