"""Encoding and decoding of whole texts with a sentence-piece BPE vocabulary: exact merge results by backtracking."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from chronoweave.llm.common import bounded_batches, unused_name

#: What stands for a space inside pieces: a fixed value of the file format.
SPACE = "▁"
#: Kinds of pieces in the file format: fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

#: Longest chunk that a worker's cache keeps, characters and ids that it keeps in all, and remembered pairs.
CHUNK, CACHE_SIZE, PAIRS = 64, 16_000_000, 2_000_000
#: Ids in one Arrow batch that a worker gives back, about.
OUT_IDS = 1 << 20


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("replace_each_byte", _one_by_one)


class PieceModel:
    """Vocabulary tables of a BPE model file whose text rules are: no character mapping, a space put before the text, no white space removed."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = model_pb2.ModelProto.FromString(f.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("text rules other than a space before the text are not supported")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.order = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.text = [p.piece for p in spec.pieces]
        self.sizes = [len(p.piece) for p in spec.pieces]
        self.end = spec.trainer_spec.eos_id
        self.bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = {c for p in self.ids for c in p}
        #: ASCII characters of no piece: texts are cut around them.
        self.strangers = "".join(c for c in map(chr, range(128)) if c not in letters and c != " ")
        # Pieces that the merges never give are no candidates. Each known character is one.
        whole = {p: i for p, i in self.ids.items() if len(p) == 1 or self.remerged(p)}
        if missing := letters - whole.keys():
            raise ValueError(f"characters without a piece of their own: {sorted(missing)[:5]}")
        self.automaton = ahocorasick.Automaton()
        for p, i in whole.items():
            self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        #: The longest candidate that is a proper prefix of each candidate, or -1.
        self.shorter = {i: next((whole[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), -1) for p, i in whole.items()}
        self.surfaces = [self._surface(p, spec.trainer_spec.unk_surface) for p in spec.pieces]
        self.controls = {i for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}

    def _surface(self, piece, unknown: str) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:-1], 16)])
        if piece.type == NORMAL:
            return piece.piece.replace(SPACE, " ").encode()
        return unknown.encode() if piece.type == UNKNOWN else b""

    def remerged(self, text: str, border: int = 0) -> bool:
        """Whether merging ``text`` from characters gives one piece (no border), or never joins anything across ``border``.

        The pair of neighbours that forms the best piece is merged first, the leftmost of equals.
        """
        symbols, starts = list(text), list(range(len(text)))
        score = self.order.get
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                break
            if border and starts[at + 1] == border:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del starts[at + 1]
        return border > 0 or len(symbols) == 1


class PieceEncoder:
    """Ids of texts, equal to what merging gives.

    A sequence of pieces is the result of the merges exactly if each piece, merged anew from its characters, gives itself
    and no two neighbours, merged anew side by side, join across their border. So the encoder walks from left to right,
    takes the longest piece that a sweep of the Aho-Corasick automaton found there and that goes with the piece before,
    else its prefixes, and steps back where none does; a bit for each position marks those that led nowhere.

    Texts are cut where no piece reaches across: before spaces, around characters of no piece, and, in long chunks,
    between neighbours that stand together in no piece. Ids of short chunks are kept in a cache of bounded size.
    """

    def __init__(self, model: PieceModel, cache_size: int = CACHE_SIZE):
        self.model, self.cache_size, self.held = model, cache_size, 0
        self.pairs: dict[int, bool] = {}
        out = re.escape(model.strangers)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}{out}]*|[{out}]|[^{SPACE}{out}]+").findall
        self.cache: dict[str, bytes] = _Chunks(self)
        self.older: dict[str, bytes] = {}

    def _fits(self, key: int) -> bool:
        """Whether the pieces of ``key`` (first id, then 20 bits of the second) stay apart side by side."""
        a, b = self.model.text[key >> 20], self.model.text[key & 0xFFFFF]
        known = a[-1] + b[0] not in self.model.bigrams or self.model.remerged(a + b, len(a))
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def backtrack(self, chunk: str) -> bytes:
        """Ids of one chunk as little-endian 32-bit integers."""
        n, sizes, shorter, pairs = len(chunk), self.model.sizes, self.model.shorter, self.pairs
        longest = array("i", [-1]) * n
        for stop, (piece, reach) in self.model.automaton.iter(chunk):  # of pieces with one start, longer ones come later
            longest[stop - reach] = piece
        dead = bytearray()  # a bit for each position, made when the first one is marked
        found, at, last = array("i"), 0, -1
        floor = 0  # what stands before is settled: a character of no piece lets nothing join
        piece = longest[0]
        while at < n:
            if longest[at] < 0:
                found.extend(self.model.byte_id[b] for b in chunk[at].encode())
                at, floor, last = at + 1, len(found), -1
                piece = longest[at] if at < n else -1
                continue
            while piece >= 0:
                stop = at + sizes[piece]
                if not (dead and dead[stop >> 3] >> (stop & 7) & 1):
                    if last < 0:
                        break
                    key = last << 20 | piece
                    fits = pairs.get(key)
                    if self._fits(key) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                found.append(piece)
                last, at = piece, stop
                piece = longest[at] if at < n else -1
            else:
                dead = dead or bytearray((n >> 3) + 1)
                dead[at >> 3] |= 1 << (at & 7)
                piece = found.pop()  # its end is dead now, so a shorter one is tried
                at -= sizes[piece]
                last = found[-1] if len(found) > floor else -1
        return found.tobytes()

    def long_chunk(self, chunk: str) -> bytes:
        codes = np.frombuffer(chunk.encode("utf-32-le"), "<u4").astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        cuts = (np.flatnonzero(~np.isin(pairs, _bigram_codes(self.model))) + 1).tolist()
        parts = [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        return b"".join([self.cache[p] if len(p) <= CHUNK else self.backtrack(p) for p in parts])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE))))


class _Chunks(dict):
    def __init__(self, owner: PieceEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        owner = self.owner
        if len(chunk) > CHUNK:
            return owner.long_chunk(chunk)
        ids = owner.older.get(chunk)
        if ids is None:
            # What ends in a mark that nothing before it joins is kept as two.
            ids = self[chunk[:-1]] + self[chunk[-1]] if len(chunk) > 1 and not chunk[-1].isalnum() and chunk[-2:] not in owner.model.bigrams else owner.backtrack(chunk)
        owner.held += len(chunk) + len(ids) // 4
        if owner.held > owner.cache_size // 2:
            owner.older = dict(self)
            self.clear()
            owner.held = 0
        self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def _bigram_codes(model: PieceModel) -> np.ndarray:
    return np.sort(np.array([ord(a) << 21 | ord(b) for a, b in model.bigrams], np.int64))


def decoded(model: PieceModel, ids: Iterable[int]) -> str:
    """The text of a row of ids. Bytes that are no UTF-8 become U+FFFD one by one; ids of no piece are an error."""
    ids = list(ids)
    if ids and not 0 <= min(ids) <= max(ids) < len(model.surfaces):
        raise ValueError("an id beyond the vocabulary")
    first = next((i for i in ids if i not in model.controls), None)
    out, since = [], 0
    for stop in [*(k for k, i in enumerate(ids) if i in model.controls), len(ids)]:  # bytes on both sides of a control piece form no character
        if stop > since:
            out.append(b"".join(map(model.surfaces.__getitem__, ids[since:stop])).decode("utf-8", "replace_each_byte"))
        since = stop + 1
    text = "".join(out)
    return text[1:] if first in model.spaced else text


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True) -> DataFrame:
    """(doc_id, ids), a row for each row of ``docs``: the ids of its whole text and, with ``end_id``, the end id.

    Null text counts as empty: the end id alone. Ids of rows, null or repeated, pass through. Strings of control pieces
    inside texts are plain text. Other columns, whatever their names, are not read. An empty table gives no rows. A text
    of any length is encoded whole; beside text and ids, an unbroken run of characters needs some ten bytes for each.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        encoder, end = PieceEncoder(model), np.array([model.end] * end_id, "<i4").tobytes()

        def out(rows: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            sizes = np.cumsum([0, *(len(x) // 4 for x in ids)])
            return pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])

        for batch in batches:
            held, since, size = [], 0, 0
            for at, text in enumerate(batch.column(1)):
                held.append((encoder(text.as_py()) if text.is_valid else b"") + end)
                size += len(held[-1]) // 4
                if size > OUT_IDS:
                    yield out(batch.column(0).slice(since, len(held)), held)
                    held, since, size = [], at + 1, 0
            if held:
                yield out(batch.column(0).slice(since, len(held)), held)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with ``out_col``, the text of ``ids_col``; null ids give null, no ids the empty text. A column of that name is replaced.

    Control pieces give nothing; one space before the first other piece goes, as encoding put it there. An id beyond the
    vocabulary is an error. Other columns stay as they are; an empty table gives no rows.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select(*(c for c in rows.columns if c.lower() != out_col.lower() or c == ids_col))
    read = unused_name(rows, "ids")
    keep = [c for c in rows.columns if c.lower() != out_col.lower()]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = pa.array([decoded(model, x.values.to_numpy()) if x.is_valid else None for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, out_col])

    return rows.select(*(F.col(f"`{c}`") for c in keep), F.col(ids_col).alias(read)).mapInArrow(run, schema)
