"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 state machine.

A vocabulary whose every token is what its own bytes merge into cuts a byte string in just one way into tokens of which
each two neighbours, merged together, stay those two. So the tokens are the one path through an automaton that guesses where
each token ends. It is made deterministic while it runs: a state holds all paths that can still go on, each as (last
token, bytes of the token begun, tokens held back), and a token is put out as soon as all of them agree on it. No path
looks further ahead than the longest token. Transitions are found once and kept.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.texts import release, slices, table

RANKS = "byte_bpe_50k.tiktoken"
#: Bounds of a worker's tables; they are emptied beyond them, which costs time and changes no result.
STATES_KEPT, JOINS_KEPT, PIECES_KEPT, PENDING_KEPT = 150_000, 150_000, 120_000, 1_000
#: Longest piece, in characters, whose tokens are kept.
PIECE_KEPT = 40
#: Code points of Latin, Greek and Cyrillic with their marks and signs, all assigned long ago.
USUAL = (*range(0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0))
_UNUSUAL = re.compile("[^\x00-\u052f\u2000-\u206f\u20a0-\u20bf]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from a file with a line for each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], parts_left: int = 1) -> list[bytes]:
    """The parts that remain when the pair with the lowest rank, the first of them, is merged again and again, down to ``parts_left``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > parts_left:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            break
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


#: Rank of what is merged no more, and mark of a beginning that is no token.
NEVER, NO_TOKEN = 1 << 40, -1
_ONE = [bytes([i]) for i in range(256)]


class State(dict):
    """A byte to the next state and the tokens put out, found when it is first asked for."""

    __slots__ = ("paths", "machine")

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        self[byte] = found = self.machine.move(self.paths, byte)
        return found


class Transducer:
    """Tokens of one piece of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [one for one in _ONE if one not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary has all bytes; missing: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Beginnings of tokens, with the lowest rank of the tokens that begin so.
        self.lowest: dict[bytes, int] = {token: rank for token, rank in ranks.items()}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                begun = token[:k]
                self.lowest[begun] = min(rank, self.lowest.get(begun, NEVER))
        self.ends: dict[int, list[tuple[bytes, int]]] = {}
        #: Token to the two that it is merged from; a byte is merged from none.
        self.halves: dict[int, tuple[int, int]] = {ranks[one]: (NO_TOKEN, NO_TOKEN) for one in _ONE}
        self.joins: dict[int, bool] = {}
        #: Most tokens that a path has held back so far.
        self.held = 0
        self.states: dict[tuple, State] = {}
        self.first = self._state(((None, b"", ()),))

    def _state(self, paths: tuple) -> State:
        found = self.states.get(paths)
        if found is None:
            if len(self.states) >= STATES_KEPT:
                for state in self.states.values():
                    state.clear()
                self.states = {self.first.paths: self.first}
            found = self.states[paths] = State()
            found.paths, found.machine = paths, self
        return found

    def _halves(self, token: int) -> tuple[int, int]:
        found = self.halves.get(token)
        if found is None:
            left, right = merged(self.tokens[token], self.ranks, 2)
            found = self.halves[token] = self.ranks[left], self.ranks[right]
        return found

    def joined(self, left: int, right: int) -> bool:
        """Whether two neighbours stay those two when their bytes are merged from the start.

        Going back through the merges that made them, no two parts that met at the boundary may have had a merge of their
        own due before the next merge on either side; of equal ranks the one to the left is due first.
        """
        tokens, ranks, left_next, right_next = self.tokens, self.ranks, NEVER, NEVER
        left_from, right_from = self._halves(left)[1], self._halves(right)[0]
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < left_next and across <= right_next:
                return False
            # the later merge is undone first, of equal ones the right
            if left_from == NO_TOKEN or (right_from != NO_TOKEN and right >= left):
                if right_from == NO_TOKEN:
                    return True
                right_next, right = right, right_from
                right_from = self._halves(right)[0]
            else:
                left_next, left = left, left_from
                left_from = self._halves(left)[1]

    def _ends(self, token: int) -> list[tuple[bytes, int]]:
        """The parts of a token that were its last one while it was merged, with the rank of the merge that took each up."""
        found = self.ends.get(token)
        if found is None:
            found, part, taken = [], token, NEVER
            while part != NO_TOKEN:
                found.append((self.tokens[part], taken))
                part, taken = self._halves(part)[1], part
            self.ends[token] = found
        return found

    def _free(self, last: int, begun: bytes) -> bool:
        """Whether ``last`` stays apart from any token with this beginning: no merge across is due before one on its own side."""
        for part, taken in self._ends(last):
            if self.lowest.get(part + begun, NEVER) < taken:
                return False
            for k in range(1, len(begun)):
                if self.ranks.get(part + begun[:k], NEVER) < taken:
                    return False
        return True

    def move(self, paths: tuple, byte: int) -> tuple[State, tuple[int, ...]]:
        """The state after a byte and the tokens put out."""
        one, ranks, lowest, joins, ended, after = _ONE[byte], self.ranks, self.lowest, self.joins, None, []
        for path in paths:
            last, begun, held = path
            begun += one
            if begun not in lowest:
                continue
            if last is not None and len(begun) <= 3 and self._free(last, begun):
                last = None
            after.append((last, begun, held))
            if ended is None and (rank := ranks.get(begun)) is not None:  # no other path ends a token here
                stays = last is None or joins.get(last << 32 | rank)
                if stays is None:
                    if len(joins) >= JOINS_KEPT:
                        joins.clear()
                    stays = joins[last << 32 | rank] = self.joined(last, rank)
                if stays:
                    ended = (*held, rank)
        if ended is None:
            raise ValueError("the vocabulary cannot cut a text; some token is not what its own bytes merge into")
        after.append((ended[-1], b"", ended))
        out = after[0][2]
        if out:  # else the oldest path holds nothing back, so nothing is certain
            shared = len(commonprefix([held for _, _, held in after]))
            out = out[:shared]
            if out:
                after = [(last, begun, held[shared:]) for last, begun, held in after]
        if len(ended) - len(out) > self.held:
            self.held = len(ended) - len(out)
        return self._state(tuple(after)), out

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """The tokens of a piece, each as soon as it is certain; the piece may come byte by byte."""
        state = self.first
        for byte in piece:
            state, out = state[byte]
            yield from out
        yield from state.paths[-1][2]  # the last path ends where the piece ends

    def run(self, piece: bytes) -> list[int]:
        """The same, of a piece that is there."""
        state, ids = self.first, []
        for byte in piece:
            state, out = state[byte]
            if out:
                ids += out
        ids += state.paths[-1][2]
        return ids


class _Pieces(dict):
    """Ids of pieces of text as 32-bit integers, kept for those seen last: a full table becomes the older one, which is asked once more."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or array("i", self.transducer.run(piece.encode())).tobytes()
        if len(piece) <= PIECE_KEPT:
            if len(self) >= PIECES_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _Classes(dict):
    """For characters newer than this Python's tables, one of the class that the other library's tables have for it."""

    def __init__(self):
        import tiktoken

        one_byte = {bytes([i]): i for i in range(256)}
        self.known = [(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=one_byte, special_tokens={}), ord(c)) for p, c in ((r"\p{L}", "一"), (r"\p{N}", "①"), (r"\s", "　"))]

    def __missing__(self, code: int) -> int:
        self[code] = found = next((c for e, c in self.known if e.encode_ordinary(chr(code))), 0xA7) if _unassigned(chr(code)) else code
        return found


def _unassigned(char: str) -> bool:
    import unicodedata

    return unicodedata.category(char) == "Cn"


def explicit(pattern: str, codes: Iterable[int]) -> re.Pattern:
    """``pattern`` for texts of these code points alone, with letters and numbers listed, for the engine that knows no such classes but is faster."""
    listed = {}
    for name in (r"\p{L}", r"\p{N}"):
        known = regex.compile(name)
        listed[name] = "".join(re.escape(chr(c)) for c in codes if known.match(chr(c)))
    fill = lambda m: regex.sub(r"\\p\{[LN]\}", lambda c: listed[c[0]], m[0] if m[0][0] == "[" else f"[{m[0]}]")
    return re.compile(regex.sub(r"\[[^\]]*\]|\\p\{[LN]\}", fill, pattern))


class Coder:
    """Ids of whole texts, each match of ``pattern`` separately, and texts of ids."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.pieces = _Pieces(self.transducer)
        self.pattern, self.quick = regex.compile(pattern), explicit(pattern, USUAL)
        self.classes: _Classes | None = None

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, with characters classed as the library of the ranks file classes them."""
        if text.isascii() or not _UNUSUAL.search(text):
            return self.quick.findall(text)
        if any(map(_unassigned, set(text))):
            self.classes = self.classes or _Classes()
            plain = text.translate(self.classes)
            return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        return self.pattern.findall(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), np.int32)


def _ranges() -> Iterator[tuple[range, int, int, int]]:
    """Lead bytes of UTF-8, the number of bytes that follow, and the bounds of the first of these."""
    yield range(0xC2, 0xE0), 1, 0x80, 0xBF
    yield range(0xE0, 0xE1), 2, 0xA0, 0xBF
    yield range(0xE1, 0xED), 2, 0x80, 0xBF
    yield range(0xED, 0xEE), 2, 0x80, 0x9F
    yield range(0xEE, 0xF0), 2, 0x80, 0xBF
    yield range(0xF0, 0xF1), 3, 0x90, 0xBF
    yield range(0xF1, 0xF4), 3, 0x80, 0xBF
    yield range(0xF4, 0xF5), 3, 0x80, 0x8F


LEADS = {lead: (follow, low, high) for leads, follow, low, high in _ranges() for lead in leads}
ODD = "�"


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, str]:
    """The state machine: bytes of the character begun and a byte, to those bytes and the characters that are complete.

    The longest beginning of a character that cannot go on becomes U+FFFD, as does a byte that begins none.
    """
    if pending:
        follow, low, high = LEADS[pending[0]]
        if len(pending) > 1:
            low, high = 0x80, 0xBF
        if low <= byte <= high:
            pending += bytes([byte])
            return (b"", pending.decode()) if len(pending) > follow else (pending, "")
        after, out = utf8_step(b"", byte)
        return after, ODD + out
    if byte < 0x80:
        return b"", chr(byte)
    return (bytes([byte]), "") if byte in LEADS else (b"", ODD)


class Pending(dict):
    """The bytes of a character begun: token to what is pending after it and the characters that are complete."""

    __slots__ = ("bytes", "decoder")

    def __missing__(self, token: int) -> tuple[Pending, str]:
        after, out = self.bytes, []
        for byte in self.decoder.tokens[token]:
            after, chars = utf8_step(after, byte)
            out.append(chars)
        self[token] = found = self.decoder.pending(after), "".join(out)
        return found


class Decoder:
    """Texts of tokens, a token at a time; a character whose bytes lie in several tokens comes with the last of them."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.states: dict[bytes, Pending] = {}

    def pending(self, begun: bytes = b"") -> Pending:
        found = self.states.get(begun)
        if found is None:
            if len(self.states) >= PENDING_KEPT:
                for state in self.states.values():
                    state.clear()
                self.states = {}
            found = self.states[begun] = Pending()
            found.bytes, found.decoder = begun, self
        return found

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = self.pending()
        for token in ids:
            state, chars = state[token]
            yield chars
        if state.bytes:
            yield ODD


def ranks_path(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(RANKS)


@cache
def coder(path: str | None = None, pattern: str | None = None) -> Coder:
    import public_tokenizers

    return Coder(ranks_path(path), pattern or public_tokenizers.PATTERN)


@cache
def decoder(path: str | None = None) -> Decoder:
    return Decoder({rank: token for token, rank in read_ranks(ranks_path(path)).items()})


def _encode(path: str | None, pattern: str | None, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = coder(path, pattern), decoder(path)
        for doc_id, text in slices(batches):
            found = [own.ids(t) for t in text]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
            columns = {"doc_id": pa.array(doc_id, pa.int64()), "ids": lists}
            if decoded:
                columns["decoded"] = pa.array(["".join(back.stream(f.tolist())) for f in found], pa.string())
            yield pa.record_batch(columns)
        release()

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for doc_id, ids in slices(batches):
            texts = ["".join(own.stream(i or ())) for i in ids]
            yield pa.record_batch([pa.array(doc_id, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        release()

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, ids (array of int); with ``decoded`` also the text that the ids decode to.

    ``path`` is a file of ranks, ``pattern`` what is encoded separately; the defaults are the public ones. Null and empty
    texts have no ids. Repeated rows and rows without id are encoded like any other; other columns are not read; no row
    moves between tasks; an empty table gives no rows. A vocabulary without some byte, or with a token that its own bytes
    do not merge into, raises an error once a text needs it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(path, pattern, decoded), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id, ids, decoded. Null ids decode to the empty text, bytes that are no UTF-8 to U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, decoded string")


def op12_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
