"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

The vocabulary of a public BPE model with byte fallback is read from its file (nothing is trained);
the driver reads it once and broadcasts its bytes. Text is encoded as the model does: a space in
front, spaces written as U+2581, then an agenda of candidate merges ordered by score and, among equals,
from the left. Each candidate taken from the agenda is skipped with the chance of the dropout rate,
drawn by a keyed hash of (seed, document id, place of the unit in the text) for every occurrence of a
unit by itself: the hash gives the number of candidates up to the next one that is skipped. So one
seed always gives one segmentation and other seeds others. What is cached does not depend on the
draw: the pieces of a unit if none of its candidates is skipped, and their number. All other
occurrences of a batch run their agendas side by side. With a rate of 0 the pieces are the model's own.

Decoding joins the pieces' bytes, turns U+2581 back to spaces and takes off the first one. A U+2581
in the text itself is written by byte pieces, so every text decodes to itself.

A null text encodes to null and decodes to null, an empty one to no pieces. Repeated rows encode
alike. Extra columns are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CACHED = 100_000
#: Units of up to so many characters run their agendas side by side, about so many of them at once.
_SHORT, _ROWS = 40, 8192
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Codec:
    """Encoder and decoder of one vocabulary; `rate` is the chance that a candidate merge is skipped."""

    def __init__(self, model: bytes, rate: float = 0.1, seed: int = 0) -> None:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=model)
        self.number: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                self.raw.append(b"")
            else:
                self.number[piece] = i
                self.raw.append(piece.replace(MARK, " ").encode())
        self.rank = {p: n for n, p in enumerate(sorted(self.number, key=lambda p: -own.get_score(self.number[p])))}
        #: Rank of each character that is a piece, by code point.
        self.letters = np.full(0x110000, -1, np.int32)
        for p, n in self.rank.items():
            if len(p) == 1:
                self.letters[ord(p)] = n
        self.numbers = np.array([self.number[p] for p in self.rank], np.int32)
        pairs = [(self.rank[p[:k]] * len(self.rank) + self.rank[p[k:]], n) for p, n in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank]
        self._index(np.array([k for k, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int32))
        # Units end before a space that follows something else, and beside characters that no longer piece has: no merge crosses there.
        longer = {x for p in self.rank if len(p) > 1 for x in p}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            self.units = re.compile(r".+", re.S)
        else:
            self.units = re.compile("[\n]|" + f"{MARK}*[^{MARK}\n]+|{MARK}+" if "\n" not in longer else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.rate, self.seed = rate, seed
        #: A draw of 53 bits lets as many candidates pass as there are bounds not above it; past the last one the next draw goes on.
        self.bounds = np.array([int((1 - (1 - rate) ** k) * (1 << 53)) for k in range(1, self._far(rate) + 1)], np.uint64)
        self.literal = np.array([self.byte[b] for b in MARK.encode()], "<i4").tobytes()
        self._clear()

    @staticmethod
    def _far(rate: float) -> int:
        return next((k for k in range(1, 4096) if (1 - rate) ** k < 2**-54), 4096)

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: the rank of the piece that a pair of ranks makes, by the pair's key."""
        bits = max(10, len(keys).bit_length() + 2)
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(self.rank), np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask
        self.slot_rank[at] = ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _ODD >> self.shift).view(np.int64)

    def _clear(self) -> None:
        """Cached units by number, with their pieces and the steps of their agenda if none is skipped. Number 0 stands for units that are too long, or met for the first time; 1 for a U+2581 of the text."""
        self.nodes: dict[str | None, int] = {None: 1}
        self.seen: set[str] = set()
        self.ids: list[bytes] = [b"", self.literal]
        self.limits = np.zeros(1024, np.uint64)

    def _keys(self, doc_id: object, n: int) -> np.ndarray:
        """Keys of the n units of a document."""
        own = np.uint64(xxhash.xxh3_64_intdigest(f"{self.seed}:{doc_id}".encode()))
        return c.mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + own)

    def _draws(self, keys: np.ndarray, draws: np.ndarray | int) -> np.ndarray:
        return c.mix(keys + (np.asarray(draws, np.uint64) + np.ones(1, np.uint64)) * _STEP) >> np.uint64(11)

    def _gaps(self, keys: np.ndarray, draws: np.ndarray | int) -> np.ndarray:
        """How many candidates pass before the next one that is skipped, for a key's draw of that number."""
        return np.searchsorted(self.bounds, self._draws(keys, draws), side="right")

    def _skips(self, key: int) -> Iterator[int]:
        """The steps that are skipped in the agenda of one occurrence, in order."""
        at = draw = 0
        while self.rate > 0:
            for gap in self._gaps(np.full(16, key, np.uint64), np.arange(draw, draw + 16)).tolist():
                at += gap
                if gap < len(self.bounds):
                    yield at
                    at += 1
            draw += 16

    def segment(self, unit: str, key: int = 0) -> list[str]:
        """The pieces of one occurrence of a unit, by agenda; unknown characters stay as they are."""
        return self._long(unit, self._skips(key))[0]

    def segment_many(self, units: list[str], keys: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
        """Piece numbers of each occurrence of a unit with its key's draws (None: nothing is skipped), as little-endian 32-bit, and the steps of its agenda."""
        out: list[bytes] = [b""] * len(units)
        steps = np.zeros(len(units), np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(size, kind="stable")
        edges = np.searchsorted(size[order], (5, 7, 9, 11, 13, 17, 25, _SHORT + 1)).tolist()
        for begin, end in zip([0, *edges], edges, strict=False):
            for i in range(begin, end, _ROWS):
                some = order[i : min(end, i + _ROWS)]
                self._rows([units[j] for j in some.tolist()], some, size[some], keys, out, steps)
        for j in order[edges[-1] :].tolist():
            self._one(units[j], j, keys, out, steps)
        return out, steps

    def _one(self, unit: str, j: int, keys: np.ndarray | None, out: list[bytes], steps: np.ndarray) -> None:
        pieces, steps[j] = self._long(unit, iter(()) if keys is None else self._skips(int(keys[j])))
        out[j] = self._ids(pieces)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbours make, or `never`; -1 is no neighbour."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * len(self.rank) + right)
        at = self._slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], len(self.rank)).astype(np.int32)
        other = np.flatnonzero((held != key) & (held >= 0) & (key >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[other]]
            same = held == key[other]
            out[other[same]] = self.slot_rank[at[other[same]]]
            other = other[~same & (held >= 0)]
        return out

    def _rows(self, units: list[str], where: np.ndarray, size: np.ndarray, keys: np.ndarray | None, out: list[bytes], steps: np.ndarray) -> None:
        """segment_many for units of about one length. Each has a row of places that point to the next and the last one; the place behind all rows is no place."""
        n, never = int(size.max()), len(self.rank)
        codes = np.array(units, f"<U{n}").view("<u4").reshape(-1, n)
        inside = np.arange(n) < size[:, None]
        pieces = np.where(inside, self.letters[codes], -1)
        strange = ((pieces < 0) & inside).any(axis=1)
        if strange.any():
            for j in np.flatnonzero(strange).tolist():
                self._one(units[j], int(where[j]), keys, out, steps)
            rest = np.flatnonzero(~strange)
            units, where, size, inside, pieces = [units[j] for j in rest.tolist()], where[rest], size[rest], inside[rest], pieces[rest]
            if not units:
                return
        total = pieces.size
        agenda = np.full(total + 1, never, np.int32)
        grid = agenda[:-1].reshape(-1, n)
        if n > 1:
            grid[:, :-1] = self._merged(pieces[:, :-1].ravel(), pieces[:, 1:].ravel()).reshape(-1, n - 1)
        pieces = np.append(pieces.ravel(), np.int32(-1))
        alive = np.append(inside.ravel(), False)
        index = np.arange(total + 1, dtype=np.int64)
        after, before = index + 1, index - 1
        ends = np.arange(len(units)) * n + size - 1
        after[ends], before[:-1:n] = total, total
        if keys is not None:
            own = keys[where]
            draw = np.zeros(len(units), np.int64)
            skip = self._gaps(own, 0) if self.rate > 0 else np.full(len(units), -1)
        rows, step = np.arange(len(units)), -1
        while len(rows):
            step += 1
            at = grid[rows].argmin(axis=1) + rows * n
            best = agenda[at]
            live = best != never
            if not live.all():
                steps[where[rows[~live]]] = step
                rows, at, best = rows[live], at[live], best[live]
            if keys is not None:
                skipped = skip[rows] == step
                if skipped.any():
                    some = rows[skipped]
                    agenda[at[skipped]] = never
                    draw[some] += 1
                    skip[some] = step + 1 + self._gaps(own[some], draw[some])
                    at, best = at[~skipped], best[~skipped]
            right = after[at]
            far, near = after[right], before[at]
            pieces[at], alive[right], agenda[right] = best, False, never
            after[at], before[far] = far, at
            agenda[at] = self._merged(best, pieces[far])
            agenda[near] = self._merged(pieces[near], best)
        flat = self.numbers[pieces[alive]].tobytes()
        cut = np.cumsum(np.append(0, 4 * alive[:-1].reshape(-1, n).sum(axis=1))).tolist()
        for j, x, y in zip(where.tolist(), cut, cut[1:], strict=False):
            out[j] = flat[x:y]

    def _long(self, unit: str, skips: Iterator[int]) -> tuple[list[str], int]:
        """The same with a heap, in time of n log n: pieces and number of steps."""
        rank = self.rank
        at: list[str | None] = list(unit)
        n = len(at)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := unit[i : i + 2]) in rank]
        heapify(agenda)
        step, skip = -1, next(skips, -1)
        while agenda:
            _, i, piece = heappop(agenda)
            left = at[i]
            if left is None or (j := after[i]) >= n or left + at[j] != piece:
                continue
            step += 1
            if step == skip:
                skip = next(skips, -1)
                continue
            at[i], at[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + at[k]) in rank:
                    heappush(agenda, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := at[h] + piece) in rank:
                heappush(agenda, (rank[p], h, p))
        return [p for p in at if p is not None], step + 1

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for piece in pieces:
            if (number := self.number.get(piece)) is not None:
                out.append(number)
            else:
                out.extend(self.byte[b] for b in piece.encode())
        return np.array(out, "<i4").tobytes()

    def _units(self, text: str) -> list[str | None]:
        """The units of a text; None stands for a U+2581 of the text itself."""
        if not text:
            return []
        out: list[str | None] = []
        for n, part in enumerate(text.split(MARK)):
            if n:
                out.append(None)
            marked = part.replace(" ", MARK)
            out.extend(self.units.findall(marked if n else MARK + marked))
        return out

    def _grow(self, units: list[str]) -> None:
        """Caches units. The limit of a unit is what a draw has to reach so that no step of its agenda is skipped."""
        first = len(self.ids)
        ids, steps = self.segment_many(units, None)
        self.ids.extend(ids)
        while len(self.ids) > len(self.limits):
            self.limits = np.concatenate((self.limits, np.zeros_like(self.limits)))
        self.limits[first : len(self.ids)] = np.where(steps > 0, self.bounds[np.minimum(steps, len(self.bounds)) - 1], 0)
        self.nodes.update(zip(units, range(first, len(self.ids)), strict=True))

    def encode_many(self, doc_ids: list, texts: list[str | None]) -> list[bytes | None]:
        """Piece numbers of each text, as little-endian 32-bit."""
        if len(self.ids) + len(self.seen) > _CACHED:
            self._clear()
        split = [[] if t is None else self._units(t) for t in texts]
        flat = list(chain.from_iterable(split))
        node = np.fromiter(map(self.nodes.get, flat, repeat(0)), np.int64, len(flat))
        missing = Counter([flat[i] for i in np.flatnonzero(node == 0).tolist()])
        fresh = [u for u, n in missing.items() if (n > 1 or u in self.seen) and len(u) <= _SHORT]
        self._grow(fresh)
        self.seen.update(u for u in missing if len(u) <= _SHORT)
        self.seen.difference_update(fresh)
        if fresh:
            alone = np.flatnonzero(node == 0)
            node[alone] = np.fromiter(map(self.nodes.get, [flat[i] for i in alone.tolist()], repeat(0)), np.int64, len(alone))
        keys = np.concatenate([np.zeros(0, np.uint64), *(self._keys(i, len(x)) for i, x in zip(doc_ids, split, strict=True))])
        parts = list(map(self.ids.__getitem__, node.tolist()))
        drawn = node == 0
        if self.rate > 0:
            drawn |= self._draws(keys, 0) < self.limits[node]
        drawn = np.flatnonzero(drawn)
        for i, ids in zip(drawn.tolist(), self.segment_many([flat[i] for i in drawn.tolist()], keys[drawn])[0], strict=True):
            parts[i] = ids
        ends = np.cumsum([0, *map(len, split)]).tolist()
        return [None if t is None else b"".join(parts[i:j]) for t, i, j in zip(texts, ends, ends[1:], strict=False)]

    def encode(self, text: str, doc_id: object = 0) -> list[int]:
        return np.frombuffer(self.encode_many([doc_id], [text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


@lru_cache(maxsize=2)
def _codec(model: bytes, rate: float, seed: int) -> Codec:
    """One codec for each worker process, so that its cache serves all its tasks."""
    return Codec(model, rate, seed)


def _model(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, pieces array<int>) of every row."""
    data = _model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, rate, seed)
        for batch in batches:
            for part in _parts(batch):
                rows = codec.encode_many(part.column(0).to_pylist(), part.column(1).to_pylist())
                offsets = pa.array(np.cumsum([0, *(len(r or b"") // 4 for r in rows)]), pa.int32())
                pieces = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(r or b"" for r in rows), "<i4")), mask=pa.array([r is None for r in rows]))
                yield pa.RecordBatch.from_arrays([part.column(0), pieces], ["doc_id", "pieces"])

    return c.small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, pieces array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces)."""
    data = _model(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, 0.0, 0)
        for batch in batches:
            for part in _parts(batch):
                rows = [None if p is None else codec.decode(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    return c.small_batches(encoded).select("doc_id", "pieces").mapInArrow(run, "doc_id bigint, text string")


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, lossless): digest of the pieces (little-endian 32-bit), and whether they decode to the text."""
    data = _model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, rate, seed)
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).to_pylist()
                pieces = codec.encode_many(part.column(0).to_pylist(), texts)
                n = [len(p or b"") // 4 for p in pieces]
                digests = [hashlib.sha256(p or b"").hexdigest() for p in pieces]
                same = [codec.decode(np.frombuffer(p or b"", "<i4").tolist()) == (t or "") for p, t in zip(pieces, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces_sha256", "lossless"])

    own = c.small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n_pieces bigint, pieces_sha256 string, lossless boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(c.table(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
