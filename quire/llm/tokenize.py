"""Corpus encoding with a public byte-level BPE vocabulary (problem 7).

The merges are compiled into a transducer that reads a pre-token byte by byte
and emits token ids after bounded lookahead.  A configuration is a pending id
sequence plus a node of the vocabulary's trie, the partly read next token.
Reading a byte moves each configuration down the trie; at a node that spells a
token the configuration may also close it, if the token may follow the one
before it (two neighbours are valid when the merges, applied to their joined
bytes, give back just these two).  Byte-pair encodings are closed under this
pairwise test, so a prefix has one valid closed configuration, and the set of
configurations agrees on all but its last few ids; the agreed ids are emitted.
Sets of configurations are the states of a deterministic machine whose
transitions are built the first time they are taken (lazy determinisation) and
dropped when there are too many of them; that only costs time.

Decoding is streamed: ids to bytes, bytes to characters by an incremental
UTF-8 state machine that holds an unfinished character over block ends and
gives U+FFFD for bytes that form none.

Defined results: a null or an empty text has the empty list of ids; texts of
any length are encoded whole; repeated rows are encoded alike; strings that
look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Splits a text before the merges apply (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens and machine states kept per worker before the memory is emptied.
MEMO, STATES = 400_000, 100_000
#: Rank files above this size aren't shipped to the executors.
MAX_RANKS = 64 << 20


def default_path() -> str:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → id of a rank file (base64 bytes, space, rank)."""
    if os.path.getsize(path) > MAX_RANKS:
        raise ValueError(f"{path} is larger than {MAX_RANKS} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BpeTransducer:
    """The lazily determinised machine of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                child = self.next[node].get(b)
                if child is None:
                    child = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = i
        #: Tokens that their own bytes' merges produce; others can't occur.
        self._pairs: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((-1, ((), 0)),)
        self._states: list[tuple] = [start]
        self._ids: dict[tuple, int] = {start: 0}
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, raw: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first (for short strings)."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side (left -1: at the start)."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 4 * MEMO:
                self._pairs.clear()
            want = [right] if left < 0 else [left, right]
            known = self._pairs[key] = self.merge(b"".join(self.bytes_of[i] for i in want)) == want
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition on a byte: next state and the ids emitted."""
        found: list[tuple[tuple[int, ...], int]] = []
        prev = self._states[state][0][0]
        for _, (pending, node) in self._states[state]:
            child = self.next[node].get(byte)
            if child is None:
                continue
            found.append((pending, child))
            t = self.token[child]
            if t >= 0 and self.follows(pending[-1] if pending else prev, t):
                found.append(((*pending, t), 0))
        agreed = os.path.commonprefix([p for p, _ in found])
        n = len(agreed)
        last = agreed[-1] if n else prev
        key = tuple((last, (p[n:], node)) for p, node in found)
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
        out = self._moves[state][byte] = (to, tuple(agreed))
        return out

    def run(self, raw: bytes) -> list[int]:
        """The ids of one pre-token's bytes, of any length, in one pass."""
        state, out = 0, []
        moves = self._moves
        for b in raw:
            step = moves[state].get(b)
            if step is None:
                step = self._move(state, b)
            state, emitted = step
            if emitted:
                out += emitted
        for _, (pending, node) in self._states[state]:
            if node == 0:
                out += pending
        if len(self._states) > STATES:
            self._forget()
        return out

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of a text to ``out``."""
        memo = self._memo
        extend = out.extend
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = tuple(self.run(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            extend(ids)

    def count(self, text: str) -> int:
        """The number of ids of a text."""
        memo, n = self._memo, 0
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = tuple(self.run(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            n += len(ids)
        return n

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text or "", out)
        return out.tolist()

    def decode(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of a stream of id blocks; what is held back at a block's end comes with the next."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield machine.decode(b"".join(self.bytes_of[i] for i in ids))
        yield machine.decode(b"", True)


_MACHINES: dict[str, BpeTransducer] = {}


def machine(key: str, packed: bytes) -> BpeTransducer:
    """The worker's machine of a rank file's content (built once a worker)."""
    if key not in _MACHINES:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in packed.splitlines() if line.strip())}
        _MACHINES[key] = BpeTransducer(ranks)
    return _MACHINES[key]


def _packed(df: DataFrame, path: str | None):
    """The rank file as a broadcast value (its size is checked)."""
    path = path or default_path()
    if os.path.getsize(path) > MAX_RANKS:
        raise ValueError(f"{path} is larger than {MAX_RANKS} bytes")
    with open(path, "rb") as f:
        return path, df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row of ``df``."""
    name, packed = _packed(df, path)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(name, packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, ends = array("i"), [0]
                for t in part.column(1):
                    m.encode_into(t.as_py() or "", flat)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(op, schema)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` without its text, with the number of tokens of the text."""
    file, packed = _packed(df, path)
    rest = [c for c in df.columns if c != text]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(file, packed.value)
        for batch in batches:
            n = [m.count(t.as_py() or "") for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n, pa.int64())], [*rest, name])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(name, T.LongType())])
    return df.select(*rest, text).mapInArrow(op, schema)
