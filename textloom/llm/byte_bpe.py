"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours are the
encoding of their own bytes together. That makes encoding a finite-state matter. While reading, a
nondeterministic transducer holds guesses: "the token begun here reads this path of the vocabulary
trie, and what came before it ended with that token". Its determinised form has one state per set
of guesses. States and their moves are made when first needed and kept, so the machine grows only
by what the corpus uses. Tokens that all guesses of a state agree on are emitted at once; a guess
spans one token, so output lags by at most the longest token of the vocabulary.

The text is cut by the tokenizer's pattern first, and every match is encoded separately. Whole
matches are remembered too (bounded), which is what makes repeated words cheap.

Decoding looks token bytes up and feeds them to an incremental UTF-8 machine, which holds back an
unfinished character until its remaining bytes come.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bounded_batches, in_pieces, strings

_MOST_WORDS = 300_000
_MOST_STATES = 120_000
_LEAST_SLICE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as file:
        return {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in file if line.strip())
        }


class Transducer:
    """The encoder for one vocabulary; see the module text."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = _MOST_STATES):
        self.ranks, self._most_states = ranks, most_states
        # Trie as one dict: (node, byte) -> node. A node is the token's rank, or a number beyond.
        self._step: dict[tuple[int, int], int] = {}
        self._token: dict[int, int] = {}
        prefixes: dict[bytes, int] = {b"": 0}
        for token in sorted(ranks, key=len):
            node = 0
            for i in range(len(token)):
                head = token[:i + 1]
                if head not in prefixes:
                    prefixes[head] = len(prefixes)
                    self._step[node, token[i]] = prefixes[head]
                node = prefixes[head]
            self._token[node] = ranks[token]
        self._bytes = {rank: token for token, rank in ranks.items()}
        # Tokens that their own merges do not produce never appear in an encoding.
        self._reachable: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self._forget()

    def _forget(self) -> None:
        """Starts anew with no states, which bounds memory and changes no result."""
        self._pairs.clear()
        self._numbers: dict[tuple, int] = {}
        self._guesses: list[tuple] = []
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []  # by state, then byte
        self._start = self._number(((0, ()),))

    def merge(self, text: bytes) -> list[int]:
        """The encoding by repeated merging of the lowest-ranked pair; the rule itself."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(
                ((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                 if a + b in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge completes a token; None for single bytes."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min(
                (self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if a + b in self.ranks)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What lies at a token's end while it is built, byte first, with the rank of the merge
        that takes it up. ``side`` 0: at its left end, 1: at its right end."""
        if (token, side) not in self._edges:
            parts, part, taken = [], self._bytes[token], 1 << 62
            while part is not None:
                parts.append((part, taken))
                taken = self.ranks[part]
                last = self._last_merge(part)
                part = last[side] if last else None
            self._edges[token, side] = parts[::-1]
        return self._edges[token, side]

    def _fits(self, left: int | None, right: int) -> bool:
        """Whether ``right`` may follow ``left``: no merge crosses the border between them.

        Merges happen in the order of their ranks, and a token's rank is above those of its parts.
        So the pieces at the border are replayed from bytes up: the border merge happens if its
        rank comes before the merge that takes up either piece (at equal ranks, left goes first).
        """
        if left is None:
            if right not in self._reachable:
                self._reachable[right] = self.merge(self._bytes[right]) == [right]
            return self._reachable[right]
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self._fits(None, right) and self._no_crossing(left, right)
        return known

    def _no_crossing(self, left: int, right: int) -> bool:
        ends, heads = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = ends[i], heads[j]
            crossing = self.ranks.get(a + b)
            if crossing is not None and crossing < a_taken and crossing <= b_taken:
                return False
            if i == len(ends) - 1 and j == len(heads) - 1:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def _number(self, guesses: tuple) -> int:
        """The state of a set of guesses (trie node, tokens not emitted yet and the last one)."""
        if guesses not in self._numbers:
            self._numbers[guesses] = len(self._guesses)
            self._guesses.append(guesses)
            self._moves.append({})
        return self._numbers[guesses]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and tokens emitted; made once per state and byte."""
        held, done = [], None
        for node, tokens in self._guesses[state]:
            child = self._step.get((node, byte))
            if child is None:
                continue
            held.append((child, tokens))
            token = self._token.get(child)
            if token is not None and self._fits(tokens[-1] if tokens else None, token):
                done = (0, (*tokens, token))
        if done is not None:
            held.append(done)  # always last: every prefix has one encoding
        # Emit what all guesses share; the last token before a guess stays, to judge neighbours.
        first, shared = held[0][1], 0
        most = min([len(tokens) for _, tokens in held]) - 1
        while shared < most and all(tokens[shared] == first[shared] for _, tokens in held):
            shared += 1
        emitted = first[:shared]
        if shared:
            held = [(node, tokens[shared:]) for node, tokens in held]
        after = self._number(tuple(held))
        move = self._moves[state][byte] = (after, emitted)
        return move

    def encode_word(self, word: bytes) -> list[int]:
        """The token ids of one match of the pattern."""
        if len(self._guesses) > self._most_states or len(self._pairs) > 2.5 * self._most_states:
            self._forget()
        state, moves, out = self._start, self._moves, []
        for byte in word:
            move = moves[state].get(byte)
            if move is None:
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out.extend(emitted)
        out.extend(self._guesses[state][-1][1])  # the guess whose last token ends here
        return out


class _Words(dict):
    """Packed ids (little-endian, 32 bits) of each match seen; bounded."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self._machine = machine

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _MOST_WORDS:
            self.clear()
        packed = np.array(self._machine.encode_word(word.encode()), "<u4").tobytes()
        self[word] = packed
        return packed


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int = _MOST_STATES):
        self.machine = Transducer(ranks, most_states)
        self._words = _Words(self.machine)
        self._matches = regex.compile(pattern)

    def slices(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, in slices of bounded size."""
        if len(text) <= _LEAST_SLICE:
            yield b"".join(map(self._words.__getitem__, self._matches.findall(text)))
            return
        waiting, size = [], 0
        for match in self._matches.finditer(text):
            waiting.append(self._words[match[0]])
            size += len(match[0])
            if size >= _LEAST_SLICE:
                yield b"".join(waiting)
                waiting, size = [], 0
        yield b"".join(waiting)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.slices(text)), "<u4")


class Utf8Machine:
    """Incremental UTF-8: how much of a byte stream is whole characters.

    The state is what may still follow: the number of bytes missing and the range of the next one.
    ``feed`` gives back the bytes up to the last finished (or invalid) character and keeps the rest.
    """

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def _after(lead: int) -> tuple[int, int, int]:
        """Bytes to come after a lead byte, and the range of the first of them."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def feed(self, data: bytes) -> bytes:
        data = self._held + data
        # Only the last three bytes can begin a character that is not finished.
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                missing, low, high = self._after(lead)
                tail = data[len(data) - back + 1:]
                if missing >= back and (not tail or low <= tail[0] <= high):
                    self._held = data[-back:]
                    return data[:-back]
                break
        self._held = b""
        return data

    def close(self) -> bytes:
        held, self._held = self._held, b""
        return held


class Decoder:
    """Ids to bytes or text, in slices."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self._lengths = np.array([len(p) for p in parts], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)])[:-1]
        self._all = np.frombuffer(b"".join(parts), np.uint8)

    def to_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(self._starts[ids] - (ends - lengths), lengths)
        return self._all[shift + np.arange(ends[-1])].tobytes()

    def stream(self, slices: Iterator[np.ndarray]) -> Iterator[str]:
        """Text of a stream of id slices; bytes that are no UTF-8 become U+FFFD."""
        machine = Utf8Machine()
        for ids in slices:
            yield machine.feed(self.to_bytes(ids)).decode("utf-8", "replace")
        yield machine.close().decode("utf-8", "replace")


@lru_cache(2)
def _codec(
    path: str, pattern: str, most_states: int = _MOST_STATES
) -> tuple[Encoder, Decoder]:
    """One codec per worker process and vocabulary."""
    ranks = load_ranks(path)
    # The states are many small objects that all stay: scanning them for garbage is wasted time.
    gc.set_threshold(200_000, 50, 100)
    return Encoder(ranks, pattern, most_states), Decoder(ranks)


def _row(encoder: Encoder, decoder: Decoder, text: str, ids_out: bool) -> tuple:
    ids_hash, bytes_hash, n, kept, same = hashlib.sha256(), hashlib.sha256(), 0, [], True
    machine, at = Utf8Machine(), 0
    for packed in encoder.slices(text):
        ids = np.frombuffer(packed, "<u4")
        n += len(ids)
        ids_hash.update(packed)
        raw = decoder.to_bytes(ids)
        bytes_hash.update(raw)
        piece = machine.feed(raw).decode("utf-8", "replace")
        same = same and text[at:at + len(piece)] == piece
        at += len(piece)
        if ids_out:
            kept.append(ids)
    piece = machine.close().decode("utf-8", "replace")
    same = same and text[at:] == piece
    ids = np.concatenate(kept) if kept else np.empty(0, "<u4")
    return n, ids_hash.hexdigest(), bytes_hash.hexdigest(), same, ids


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True,
    most_states: int = _MOST_STATES,
) -> DataFrame:
    """``row`` (the input row packed), n_tokens, ids_sha256, decoded_sha256, round_trip and, unless
    left out, the ids themselves.

    Null counts as the empty text, which has no tokens. ``path`` must be readable by every worker.
    ``most_states`` bounds what a worker keeps (about 1 kB a state) and changes no result; beyond it
    the machine begins anew.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(path, pattern, most_states)
        for batch in in_pieces(batches):
            texts = strings(batch.column("row").field(text_col).cast(pa.string()))
            rows = [_row(encoder, decoder, t, with_ids) for t in texts]
            n, ids_hash, bytes_hash, same, ids = zip(*rows) if rows else ((),) * 5
            columns = [batch.column("row"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()),
                       pa.array(bytes_hash, pa.string()), pa.array(same, pa.bool_())]
            names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    fields = [
        packed.schema["row"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return packed.mapInArrow(run, T.StructType(fields))


def decode(
    tokens: DataFrame, path: str, ids_col: str = "ids", slice_ids: int = 1 << 16
) -> DataFrame:
    """``tokens`` with ``text`` decoded from the ids (null ids: null text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _codec(path, "")[1]
        for batch in batches:
            texts = []
            for ids in batch.column("_ids").to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                every = np.array(ids, np.int64)
                texts.append("".join(decoder.stream(
                    every[i:i + slice_ids] for i in range(0, len(every), slice_ids))))
            yield pa.record_batch(
                [batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    columns = F.struct(*[F.col(f"`{c}`") for c in tokens.columns])
    packed = tokens.select(F.col(f"`{ids_col}`").alias("_ids"), columns.alias("row"))
    return packed.mapInArrow(
        run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
