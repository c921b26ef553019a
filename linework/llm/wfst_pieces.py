"""SentencePiece encoding by a weighted finite-state transducer.

The model file compiles into three parts: the normaliser (a dummy prefix and blanks as U+2581), the pieces as a trie of
arcs with byte fallback for characters that no piece spells, and an acceptor of neighbouring pieces that admits a pair only if merging would keep the two apart.
An input is composed with them, and the path of least tropical weight is its encoding. Merging pieces
by score has a local property: a sequence is the merge result exactly if each piece by itself and each neighbouring pair
merges to itself. So the acceptor leaves one path, of weight 0, through the pieces; byte arcs weigh 1 and unknown ones 2.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linework.llm.common import documents
from linework.llm.kernels import kept_by_worker, tidied

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED_WORDS = 500_000
#: In the trie: no piece but the beginning of one, and a piece not yet tried.
PREFIX, UNTRIED = -1, -2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class Transducer:
    """The compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for field, value in fields(model):
            if field == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), float(piece.get(2, 0.0)), int(piece.get(3, NORMAL))))
            elif field == 3:
                spec = dict(fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.byte_id = {int(p[0][1:-1], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        self.id_of = {p[0]: i for i, p in enumerate(self.pieces) if p[2] in (NORMAL, USER)}
        self.score = [p[1] for p in self.pieces]
        self.pair_kept: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.words: dict[str, bytes] = {}

    @cached_property
    def unit(self) -> re.Pattern[str]:
        """Matches the parts of a normalised text that no piece reaches beyond, so that each can be encoded by itself.

        Characters fall into kinds; a part goes on from one kind to another only where the two meet in that order inside
        some piece, and has the blanks before it. If pieces have blanks after other characters, the text is one part.
        """
        kinds = {"letter": "a-zA-Z", "digit": "0-9", "sign": "!-/:-@\\[-`{-~", "other": f"\x00-\x20\x7f-{chr(ord(SPACE) - 1)}{chr(ord(SPACE) + 1)}-\U0010ffff"}
        kind = {k: re.compile(f"[{c}]") for k, c in kinds.items()}

        def of(ch: str) -> str:
            return "blank" if ch == SPACE else next(k for k, p in kind.items() if p.match(ch))

        met = {(of(x), of(y)) for piece in self.id_of for x, y in zip(piece, piece[1:], strict=False)}
        if any(y == "blank" and x != "blank" for x, y in met):
            return re.compile(r"(?s).+")
        run = {k: f"[{c}]{'+' if (k, k) in met else ''}" for k, c in kinds.items()}
        before = {y: "".join(kinds[x] for x in kinds if x != y and (x, y) in met) for y in kinds}
        further = "|".join(f"(?<=[{before[y]}]){run[y]}" for y in kinds if before[y])
        return re.compile(f"{SPACE}*(?:{'|'.join(run.values())})" + (f"(?:{further})*" if further else "") + f"|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scoring neighbours join first, leftmost on ties."""
        parts = list(text)
        get = self.id_of.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _after(self, left: str) -> dict[str, bool]:
        """Which pieces the acceptor admits after a piece, as far as known."""
        if (known := self.pair_kept.get(left)) is None:
            if self.pairs > 1_000_000:
                self.pair_kept.clear()
                self.pairs = 0
            known = self.pair_kept[left] = {}
        return known

    def _stays(self, left: str, right: str, known: dict[str, bool]) -> bool:
        self.pairs += 1
        known[right] = found = self.merged(left + right) == [left, right]
        return found

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    @cached_property
    def trie(self) -> dict[str, int]:
        """Id of each piece, UNTRIED until it is known to merge to itself, and PREFIX for what only begins some piece."""
        out = {p[:n]: PREFIX for p in self.id_of for n in range(1, len(p))}
        return out | dict.fromkeys(self.id_of, UNTRIED)

    def _arcs(self, word: str, i: int) -> list[tuple[str, int]]:
        """Pieces that start at a place of word and merge to themselves, shortest first."""
        trie, out = self.trie, []
        for j in range(i + 1, len(word) + 1):
            piece = word[i:j]
            k = trie.get(piece)
            if k is None:
                break
            if k == UNTRIED:
                k = trie[piece] = self.id_of[piece] if self.merged(piece) == [piece] else PREFIX
            if k >= 0:
                out.append((piece, k))
        return out

    def _free_path(self, word: str) -> list[int] | None:
        """Ids of a path of weight 0, the least there is, found depth first; None if there is none."""
        n, dead = len(word), set()
        at, left, ids = 0, None, []
        trail: list[tuple] = []
        arcs = self._arcs(word, 0)
        while True:
            known = self._after(left) if left is not None else None
            while arcs:
                piece, k = arcs.pop()
                if known is not None:
                    ok = known.get(piece)
                    if ok is None:
                        ok = self._stays(left, piece, known)
                    if not ok:
                        continue
                there = at + len(piece)
                if there == n:
                    return [*ids, k]
                if (there, piece) in dead:
                    continue
                trail.append((at, left, arcs))
                ids.append(k)
                at, left, arcs = there, piece, self._arcs(word, there)
                break
            else:
                if not trail:
                    return None
                dead.add((at, left))
                at, left, arcs = trail.pop()
                ids.pop()
                continue

    def shortest_path(self, word: str) -> list[int]:
        """Ids along the least-weight path of a normalised text through pieces, byte arcs and the pair acceptor.

        A path without byte arcs weighs nothing and is taken at once. Else states after i characters are (weight, piece
        that ends there, state before, ids); an arc goes on by a piece if the acceptor admits it after the state's piece.
        Of states with one piece the lightest stays, the first on ties.
        """
        if word and (free := self._free_path(word)) is not None:
            return free
        n, trie, id_of = len(word), self.trie, self.id_of
        states: list[list[tuple]] = [[] for _ in range(n + 1)]
        states[0].append((0, "", None, None))
        for i in range(n):
            for s in states[i]:
                weight, left = s[0], s[1]
                known = self._after(left) if left in id_of else None
                for j in range(i + 1, n + 1):
                    piece = word[i:j]
                    k = trie.get(piece)
                    if k is None:
                        break
                    if k < 0:
                        if k == PREFIX:
                            continue
                        k = trie[piece] = id_of[piece] if self.merged(piece) == [piece] else PREFIX
                        if k == PREFIX:
                            continue
                    if known is not None:
                        ok = known.get(piece)
                        if ok is None:
                            ok = self._stays(left, piece, known)
                        if not ok:
                            continue
                    there = states[j]
                    if there:
                        self._put(there, (weight, piece, s, k))
                    else:
                        there.append((weight, piece, s, k))
                if word[i] not in id_of:
                    raw = word[i].encode("utf-8", "surrogatepass")
                    ids = tuple(self.byte_id[b] for b in raw) if self.byte_id else (self.unknown,)
                    self._put(states[i + 1], (weight + (1 if self.byte_id else 2), word[i], s, ids))
        if not states[n]:
            raise ValueError("no path")
        state = min(states[n], key=lambda s: s[0])
        out: list[int] = []
        while state[2] is not None:
            if isinstance(state[3], int):
                out.append(state[3])
            else:
                out += state[3][::-1]
            state = state[2]
        return out[::-1]

    @staticmethod
    def _put(states: list[tuple], new: tuple) -> None:
        for k, s in enumerate(states):
            if s[1] == new[1]:
                if new[0] < s[0]:
                    states[k] = new
                return
        states.append(new)

    def encode(self, text: str) -> np.ndarray:
        cache = self.words
        parts = self.unit.findall(self.normalise(text))
        found = list(map(cache.get, parts))
        for k, ids in enumerate(found):
            if ids is None:
                w = parts[k]
                ids = cache.get(w)
                if ids is None:
                    if len(cache) > CACHED_WORDS:
                        cache.clear()
                    ids = np.array(self.shortest_path(w), np.int32).tobytes()
                    if len(w) < 64:
                        cache[w] = ids
                found[k] = ids
        return np.frombuffer(b"".join(found), np.int32)

    @cached_property
    def shown(self) -> list[bytes]:
        """What each id puts out."""

        def of(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[1:-1], 16)])
            if kind == UNKNOWN:
                return " ⁇ ".encode()
            return (piece.replace(SPACE, " ") if self.escape else piece).encode() if kind in (NORMAL, USER) else b""

        return [of(piece, kind) for piece, _, kind in self.pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The inverse path: pieces and bytes back to text; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def machine_of(model: bytes) -> Transducer:
    """A worker's own machine for a model, with the words and pairs it has met."""
    return kept_by_worker(f"pieces:{zlib.crc32(model)}:{len(model)}", lambda: Transducer(model))


def _encoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(model)
        for batch in batches:
            names, ids = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text")):
                ids.append(machine.encode(text.as_py() or ""))
                if sum(map(len, ids[-64:])) > 1 << 20 or len(ids) == 1024:
                    yield _id_batch(names.slice(i + 1 - len(ids), len(ids)), ids)
                    ids = []
            if ids:
                yield _id_batch(names.slice(batch.num_rows - len(ids), len(ids)), ids)

    return run


def _id_batch(names: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(begin), pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have no ids."""
    return documents(docs).mapInArrow(tidied(_encoded(model), keeps=True), "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(model)
        for batch in batches:
            texts = [machine.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidied(run, keeps=True), "doc_id long, text string")


DIGEST = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"


def piece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Per document: pieces, those by byte fallback, crc32 of the ids as little-endian 32-bit numbers, and whether the decoded ids give the whole text back.

    Null and empty texts have no pieces. Rows that repeat a doc_id, null ones too, give a row each. A very long text is encoded
    part by part, and a part without a boundary as a whole. Extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(model)
        is_byte = np.array([p[2] == BYTE for p in machine.pieces])
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                ids = machine.encode(text)
                rows.append((name, len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), machine.decode(ids) == text))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return documents(docs).mapInArrow(tidied(run, keeps=True), DIGEST)
