"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes a row of symbols, one for each character.  An agenda holds the
adjacent pairs whose join is a piece; the best-scored pair (the leftmost of
equals) is merged, its new neighbours join the agenda, and so on until no pair
is left.  Symbols that are no pieces fall back to their UTF-8 bytes.

Where no piece has a space mark after another character, no merge crosses such
a place, so a text is cut there into chunks that are encoded on their own and
remembered for the next texts.  Short chunks of one length go through the
agenda in lockstep, one merge a round, as rows of an array.  A long chunk is
first cut between characters that are neighbours in no piece; parts that are
still long have an agenda of their own, in flat arrays.  Each chunk
that enters the memory is held against the library's own encoding of it, batch
by batch, and a difference fails the task.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import textbatch

MARK = "▁"
_UNKNOWN = 1 << 17  # symbols from here on are characters that are no pieces
_SHIFT = 21
_NONE = np.int32(np.iinfo(np.int32).max)
_FREE = np.int64(-1)


class PieceCoder:
    """Encoder and decoder for one model file.

    ``lockstep`` is the longest chunk for the lockstep agenda.  Once more than
    ``memory`` chunks are remembered, the short ones become ``older`` in place of
    those before; an older chunk that is met again is remembered anew.
    """

    def __init__(self, path: str, lockstep: int = 48, memory: int = 200_000, check: bool = True):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lockstep, self.memory, self.check = lockstep, memory, check
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in ids if lib.is_byte(i)}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.find = re.compile(f"{MARK}+[^{MARK}]*" if self.cut else r"(?s:.+)").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        _, order = np.unique([-lib.get_score(i) for i in plain], return_inverse=True)
        self.order = dict(zip(plain, order.tolist(), strict=True))
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k]), self.symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        self.chars = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        self.neighbours = np.array(sorted({(ord(a) << _SHIFT) | ord(b) for piece in self.ids for a, b in pairwise(piece)} or {0}), np.int64)
        self._table([(a << _SHIFT) | b for a, b in pairs], list(pairs.values()))

    def symbol(self, s: str) -> int | None:
        found = self.ids.get(s)
        return found if found is not None else _UNKNOWN + ord(s) if len(s) == 1 else None

    def _table(self, keys: list[int], merged: list[int]) -> None:
        """An open-addressing table: pair -> (place in the score order, merged piece)."""
        bits = max(10, (4 * len(keys)).bit_length())
        self._bits, self._probes = np.uint64(64 - bits), 1
        self._keys = np.full(1 << bits, _FREE, np.int64)
        self._ord = np.full(1 << bits, _NONE, np.int32)
        self._merged = np.zeros(1 << bits, np.int32)
        for slot, key, piece in zip(self._slots(np.array(keys, np.int64)).tolist(), keys, merged, strict=True):
            probes = 1
            while self._keys[slot] != _FREE:
                slot, probes = (slot + 1) & (len(self._keys) - 1), probes + 1
            self._keys[slot], self._ord[slot], self._merged[slot] = key, self.order[piece], piece
            self._probes = max(self._probes, probes)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._bits).astype(np.int64)

    def _seek(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its place in the score order (``_NONE``: no piece) and the merged piece."""
        shape, keys = keys.shape, keys.ravel()
        slot = self._slots(keys)
        there = self._keys[slot]
        for _ in range(self._probes):
            on = np.flatnonzero((there != keys) & (there != _FREE))
            if not len(on):
                break
            slot[on] = (slot[on] + 1) & (len(self._keys) - 1)
            there[on] = self._keys[slot[on]]
        return np.where(there == keys, self._ord[slot], _NONE).reshape(shape), self._merged[slot].reshape(shape)

    def _merge_rows(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Encode chunks of one length: each round merges the best pair of every row that has one."""
        width, out = len(chunks[0]), [None] * len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, width)
        known = self.chars[codes]
        rows, at = np.where(known >= 0, known, codes + _UNKNOWN), np.arange(len(chunks))
        if width > 1:
            order, merged = self._seek((rows[:, :-1] << _SHIFT) | rows[:, 1:])
        while width > 1:
            j = order.argmin(1)
            on = order[np.arange(len(at)), j] != _NONE
            if not on.all():
                self._put(out, at[~on], rows[~on])
                rows, at, j, order, merged = rows[on], at[on], j[on], order[on], merged[on]
                if not len(at):
                    return out
            every, k = np.arange(len(at)), np.arange(width)
            rows[every, j] = merged[every, j]
            rows = rows[k != j[:, None] + 1].reshape(len(at), -1)
            keep = k[:-1] != j[:, None]
            order, merged = order[keep].reshape(len(at), -1), merged[keep].reshape(len(at), -1)
            width -= 1
            for on, c in ((np.flatnonzero(j > 0), -1), (np.flatnonzero(j < width - 1), 0)):  # the new neighbours' pairs
                c = j[on] + c
                order[on, c], merged[on, c] = self._seek((rows[on, c] << _SHIFT) | rows[on, c + 1])
        self._put(out, at, rows)
        return out

    def _put(self, out: list, at: np.ndarray, rows: np.ndarray) -> None:
        odd = (rows >= _UNKNOWN).any(1).tolist()
        for i, row, x in zip(at.tolist(), map(tuple, rows.tolist()), odd, strict=True):
            out[i] = self._finish(row) if x else row

    def _parts(self, chunk: str) -> list[str]:
        """The chunk, cut between characters that stand side by side in no piece: no merge joins them."""
        codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = (codes[:-1] << _SHIFT) | codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        cuts = [0, *(np.flatnonzero(self.neighbours[at] != pair) + 1).tolist(), len(chunk)]
        return [chunk[i:j] for i, j in pairwise(cuts)]

    def _merge_heap(self, chunk: str) -> tuple[int, ...]:
        """Encode one chunk with an agenda over a linked row of symbols.

        An entry is a place in the score order and a position, as one number.
        The first pairs are a sorted array, later ones a heap; an entry holds if
        the pair that is at its position now has its place in the order.
        """
        codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.int64)
        known = self.chars[codes]
        row = np.where(known >= 0, known, codes + _UNKNOWN)
        order, _ = self._seek((row[:-1] << _SHIFT) | row[1:])
        on = np.flatnonzero(order != _NONE)
        first = np.sort((order[on].astype(np.int64) << 32) | on)
        symbols, n = array("i", row.astype(np.int32).tobytes()), len(row)
        left, right = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        later: list[int] = []
        pairs, rank = self.pairs, self.order

        def entries() -> Iterator[int]:
            for lo in range(0, len(first), 4096):
                for x in first[lo : lo + 4096].tolist():
                    while later and later[0] < x:
                        yield heapq.heappop(later)
                    yield x
            while later:
                yield heapq.heappop(later)

        for x in entries():
            a = x & 0xFFFFFFFF
            b = right[a]
            if symbols[a] < 0 or b >= n:
                continue
            piece = pairs.get((symbols[a], symbols[b]))
            if piece is None or rank[piece] != x >> 32:
                continue
            symbols[a], symbols[b] = piece, -1
            c = right[a] = right[b]
            if c < n:
                left[c] = a
                if (new := pairs.get((piece, symbols[c]))) is not None:
                    heapq.heappush(later, (rank[new] << 32) | a)
            if (c := left[a]) >= 0 and (new := pairs.get((symbols[c], piece))) is not None:
                heapq.heappush(later, (rank[new] << 32) | c)
        return self._finish(s for s in symbols if s >= 0)

    def _finish(self, symbols: Iterable[int]) -> tuple[int, ...]:
        """Bytes (or the unknown id) in place of characters that are no pieces."""
        out = []
        for s in symbols:
            if s < _UNKNOWN:
                out.append(s)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(s - _UNKNOWN).encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def _learn(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Encode chunks and hold each against the library."""
        out: dict[str, tuple[int, ...]] = {}
        by: dict[int, set[str]] = {}
        cut = {c: self._parts(c) for c in chunks if len(c) > self.lockstep}
        for c in chain((c for c in chunks if c not in cut), chain.from_iterable(cut.values())):
            by.setdefault(len(c), set()).add(c)
        for n, own in by.items():
            group, step = list(own), max(1, 400_000 // n)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                coded = self._merge_rows(part) if n <= self.lockstep else [self._merge_heap(c) for c in part]
                out.update(zip(part, coded, strict=True))
        out = {c: tuple(chain.from_iterable(out[x] for x in cut[c])) if c in cut else out[c] for c in chunks}
        if self.check:
            own = [c for c in chunks if c != MARK]
            for c, ids in zip(own, self.lib.encode([c[1:].replace(MARK, " ") for c in own], num_threads=1), strict=True):
                if tuple(ids) != out[c]:
                    raise RuntimeError(f"the library encodes {c!r} as {ids}, the agenda as {out[c]}")
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text (no end id); an empty text has none."""
        cut = [self.find((MARK + x).replace(" ", MARK)) if x else [] for x in texts]
        chunks = list(chain.from_iterable(cut))
        coded = list(map(self.known.get, chunks))
        if missing := {c for c, ids in zip(chunks, coded, strict=True) if ids is None}:
            here = {c: ids for c in missing if (ids := self.older.get(c)) is not None}
            if new := list(missing - here.keys()):
                here |= self._learn(new)
            self.known |= here
            coded = list(map(self.known.get, chunks))
            if len(self.known) > self.memory:
                self.older, self.known = self.short(), {}
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        return [list(chain.from_iterable(coded[i:j])) for i, j in pairwise(ends)]

    def short(self) -> dict[str, tuple[int, ...]]:
        return {c: ids for c, ids in self.known.items() if len(c) <= self.lockstep}

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids) if ids else []


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed tokenizer files have ``name``; looked up where it is called."""
    import public_tokenizers

    return public_tokenizers.path(name)


_coders: dict[str, PieceCoder] = {}


def coder_of(path: str) -> PieceCoder:
    """The model's coder, with the short chunks that this worker's tasks before have remembered."""
    if path not in _coders:
        _coders.clear()  # one at most
        _coders[path] = PieceCoder(path)
    coder = _coders[path]
    coder.known = coder.short()
    return coder


def encode(docs: DataFrame, model: str | None = None, text: str = "text", add_end: bool = True, decode: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int) and, if asked for, ``decoded`` text.

    ``model`` is the model file's path on the executors; by default the
    installed ``piece_bpe_32k.model``.  A null or empty text has only the end
    id and decodes to an empty text.  Rows and all other columns stay as they
    are; columns named ``piece_ids`` or ``decoded`` that were there before are
    replaced.  Nothing is shuffled.
    """
    rest = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    docs = docs.select(*rest)
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model or model_path())
        gc.disable()  # many small tuples and no cycles: walks over them would cost more than the encoding
        try:
            yield from coded(coder, batches)
        finally:
            gc.enable()

    def coded(coder: PieceCoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = textbatch.utf8(batch.column(where))[1]
            for i, j in textbatch.slices(offsets, 2 << 20):
                part = batch.slice(i, j - i)
                ids = coder.encode([x or "" for x in part.column(where).to_pylist()])
                if add_end:
                    for x in ids:
                        x.append(coder.end)
                sizes = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))]
                if decode:
                    columns.append(pa.array(coder.decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: ids and round trip of every document, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs)
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("piece_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
