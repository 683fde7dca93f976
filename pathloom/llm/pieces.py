"""SentencePiece encoding and decoding with merge-type vocabularies."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_OWN = 1 << 21  # symbols from here on stand for a code point outside the vocabulary
_PLACE, _ID = (1 << 48) - 1, (1 << 32) - 1
_BITS, _NONE, _EDGE, _GONE = 22, 1 << 24, (1 << 22) - 1, (1 << 22) - 2  # bits of a symbol, the rank of no piece, what stands around a segment, what merged
_WIDTHS, _ROWS, _FEW = (8, 16, 32, 64), 8192, 64  # places of a tree, segments merged at once, fewer go through the heap
_KEPT, _KEPT_CHARS = 300_000, 8 << 20
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, varint()
        else:
            size = {1: 8, 5: 4}[wire] if wire != 2 else varint()
            yield field, data[at : at + size]
            at += size


class Vocabulary:
    """A merge-type SentencePiece model: encode() and decode() agree with the library's.

    Supported: BPE models with byte fallback, identity normalisation, a dummy prefix and kept extra
    spaces, without user-defined or unused pieces, in which the space mark only starts a piece.
    Other models raise ValueError rather than give other ids.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.path = path
        names: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        normal = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        fits = trainer.get(3) == 2 and trainer.get(35) == 1 and not set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}
        fits &= not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        fits &= not any(SPACE in n.lstrip(SPACE) for n in normal)
        if not fits:
            raise ValueError(f"{path}: not a supported merge-type model")
        self.names, self.kinds = names, kinds
        self.bytes_at = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        self.raw = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.raw = [" ⁇ ".encode() if k == UNKNOWN else r for r, k in zip(self.raw, kinds, strict=True)]
        self.decimal = [b"%d" % i for i in range(len(names))]
        symbol = dict(normal)
        for name in normal:
            for c in name:
                symbol.setdefault(c, _OWN + ord(c))
        self.of_char = np.arange(_OWN, _OWN + 0x110000, dtype=np.int64)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        distinct = sorted({scores[i] for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(distinct)}
        self.pairs: dict[int, int] = {}  # two symbols to the rank of their piece's score and its id
        for name, i in normal.items():
            for k in range(1, len(name)):
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank_of[scores[i]] << 32 | i
        self._table()
        self.known: dict[str, int] = {}
        self.known_ids: list[bytes] = []
        self.known_text: list[bytes] = []
        self.known_met = bytearray()  # 1 for a segment met again since the cache was last thinned out
        self.known_chars = 0
        self._library = None

    def _agenda(self, symbols: list[int]) -> list[int]:
        """Merge by an agenda of adjacent pairs, best score first, then leftmost; one entry is a rank and a place."""
        n = len(symbols)
        get = self.pairs.get
        heap = [(found >> 32) << 48 | k for k in range(n - 1) if (found := get(symbols[k] << 32 | symbols[k + 1])) is not None]
        if not heap:
            return symbols
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            entry = pop(heap)
            a = entry & _PLACE
            b = after[a]
            if b < 0 or symbols[a] < 0:
                continue  # merged into another meanwhile
            found = get(symbols[a] << 32 | symbols[b])
            if found is None or found >> 32 != entry >> 48:
                continue  # the pair is another meanwhile, with an entry of its own
            symbols[a], symbols[b] = found & _ID, -1
            c = after[a] = after[b]
            if c >= 0:
                before[c] = a
                if (found := get(symbols[a] << 32 | symbols[c])) is not None:
                    push(heap, (found >> 32) << 48 | a)
            p = before[a]
            if p >= 0 and (found := get(symbols[p] << 32 | symbols[a])) is not None:
                push(heap, (found >> 32) << 48 | p)
        return [s for s in symbols if s >= 0]

    def _table(self) -> None:
        """The pairs once more, in a hash table with linear probes that arrays of pairs are looked up in."""
        pairs = np.fromiter(self.pairs, np.int64, len(self.pairs))
        keys = pairs >> 32 << _BITS | pairs & _ID
        found = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        bits = max(4 * len(keys), 16).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.slot_found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE << 32, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = keys[free]  # one of those that share a slot stays
            left = left[self.slots[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.mask
        self.slot_found[at] = found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that pairs of symbols make; _NONE where they make none."""
        keys = left.astype(np.int64) << _BITS | right
        at = self._slot(keys)
        slots = self.slots[at]
        found = self.slot_found[at]
        miss = slots != keys
        found[miss] = _NONE << 32
        open_ = np.flatnonzero(miss & (slots >= 0))
        while open_.size:
            at[open_] = at[open_] + 1 & self.mask
            slots = self.slots[at[open_]]
            hit = slots == keys[open_]
            found[open_[hit]] = self.slot_found[at[open_[hit]]]
            open_ = open_[~hit & (slots >= 0)]
        return (found >> 32).astype(np.int32), found.astype(np.int32)

    def _agendas(self, symbols: np.ndarray) -> None:
        """_agenda() for many short segments at once, in place: a row each, _EDGE before and after its symbols.

        The agenda of a row is a tournament tree over its places: a leaf is the rank of the pair that begins there,
        then the place, the root is the best of them. A round takes every row's root, merges that pair and
        renews the three leaves that this changes, with the nodes above them.
        """
        rows, width = symbols.shape
        rank, into = np.full((rows, width), _NONE, np.int32), np.zeros((rows, width), np.int32)
        rank[:, :-1], into[:, :-1] = (x.reshape(rows, -1) for x in self._found(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        tree = np.empty((rows, 2 * width), np.int32)
        tree[:, width:] = rank << 6 | np.arange(width, dtype=np.int32)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        before, after = (np.tile(np.arange(width) + step, rows) for step in (-1, 1))
        symbols, into, tree = symbols.reshape(-1), into.reshape(-1), tree.reshape(-1)
        none = _NONE << 6
        live = np.arange(rows)
        while True:
            top = tree[live * (2 * width) + 1]
            going = top < none
            live, top = live[going], top[going]
            if not live.size:
                return
            row, root = live * width, live * (2 * width)
            a = top & 63
            at = row + a
            b, p = after[at], before[at]
            c = after[row + b]
            symbols[at], symbols[row + b] = into[at], _GONE
            after[at], before[row + c] = c, a
            two = np.concatenate([at, row + p])
            rank, made = self._found(symbols[two], symbols[np.concatenate([row + c, at])])
            into[two] = made
            place = np.concatenate([a, p, b]) + width
            root = np.concatenate([root, root, root])
            tree[root + place] = np.concatenate([rank << 6, np.full(live.size, none, np.int32)]) | place - width
            half = width // 2
            while half:
                place >>= 1
                node = root + place
                child = node + place
                tree[node] = np.minimum(tree[child], tree[child + 1])
                half //= 2

    def _merged(self, points: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """The final symbols of segments whose first symbols follow each other in points."""
        out: list[list[int]] = [[]] * sizes.size
        starts = np.cumsum(sizes) - sizes
        kind = np.searchsorted(np.array(_WIDTHS), sizes + 2)
        for k, width in enumerate(_WIDTHS):
            same = np.flatnonzero(kind == k)
            if same.size < _FEW:
                kind[same] = len(_WIDTHS)
                continue
            for x in range(0, same.size, _ROWS):
                some = same[x : x + _ROWS]
                spot = starts[some][:, None] + np.arange(-1, width - 1)
                inside = (spot >= starts[some][:, None]) & (spot < (starts + sizes)[some][:, None])
                symbols = np.full((some.size, width), _EDGE, np.int32)
                symbols[inside] = points[spot[inside]]
                self._agendas(symbols)
                stay = symbols < _GONE
                flat, ends = symbols[stay].tolist(), np.cumsum(stay.sum(1)).tolist()
                for i, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
        for i in np.flatnonzero(kind == len(_WIDTHS)).tolist():
            out[i] = self._agenda(points[starts[i] : starts[i] + sizes[i]].tolist())
        return out

    def _learn(self, keys: list[str]) -> None:
        """Encode segments not met before; each is a space and a word. All are checked against the library."""
        size = len(self.names)
        decimal, text = self.decimal.__getitem__, self.raw.__getitem__
        for x in range(0, len(keys), 20_000):
            some = keys[x : x + 20_000]
            points = self.of_char[np.frombuffer((SPACE + SPACE.join(some)).replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
            sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
            final = self._merged(points, sizes)
            for i in np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(points >= size), "right")).tolist():
                # code points outside the vocabulary fall back to bytes
                final[i] = [y for s in final[i] for y in ([s] if s < size else [self.bytes_at[b] for b in chr(s - _OWN).encode()])]
            real = [i for i, k in enumerate(some) if k]  # the library has no lone prefix
            for i, ids in zip(real, self.library().encode([some[i] for i in real], num_threads=1), strict=True):
                if ids != final[i]:
                    raise ValueError(f"ids differ from the library's for {some[i][:80]!r}")
            start = len(self.known_ids)
            self.known.update(zip(some, range(start, start + len(some)), strict=True))
            self.known_ids += [b",".join(map(decimal, ids)) for ids in final]
            self.known_text += [b"".join(map(text, ids)) for ids in final]
        self.known_met += bytes(len(keys))
        self.known_chars += sum(map(len, keys))

    def library(self):  # noqa: ANN201
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._library

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text's segments, each without the one space (or dummy prefix) that starts it."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [s[1:].replace(SPACE, " ") for s in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def meet(self, parts: list[list[str]]) -> None:
        """Learn the segments of these texts that the cache lacks. When full, it keeps those met more than once
        since it was last full, or starts anew if they are too many themselves."""
        keys = list(dict.fromkeys(chain.from_iterable(parts)))
        met = self.known_met
        new = []
        for k, at in zip(keys, map(self.known.get, keys), strict=True):
            if at is None:
                new.append(k)
            else:
                met[at] = 1
        if self._full(new):
            self._thin()
            if self._full(new):
                self.known, self.known_ids, self.known_text, self.known_met, self.known_chars = {}, [], [], bytearray(), 0
                new = keys
        if new:
            self._learn(new)

    def _full(self, new: list[str]) -> bool:
        return len(self.known) + len(new) > _KEPT or self.known_chars > _KEPT_CHARS

    def _thin(self) -> None:
        met = self.known_met
        self.known_ids, self.known_text = list(compress(self.known_ids, met)), list(compress(self.known_text, met))
        self.known = {k: i for i, k in enumerate(compress(self.known, met))}  # keys are in the order of their places
        self.known_met, self.known_chars = bytearray(len(self.known)), sum(map(len, self.known))

    def both(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text the number of ids, the ids in decimal joined by commas, and the decoded text in UTF-8."""
        parts = [self.segments(t) for t in texts]
        self.meet(parts)
        known, ids_of, text_of = self.known.__getitem__, self.known_ids.__getitem__, self.known_text.__getitem__
        for keys in parts:
            at = list(map(known, keys))
            ids, out = b",".join(map(ids_of, at)), b"".join(map(text_of, at))
            yield ids.count(b",") + 1 if ids else 0, ids, out[1:] if out[:1] == b" " else out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.both([text]))[1].split(b",")] if text else []

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if ids and out[:1] == " " and self.names[ids[0]].startswith(SPACE) else out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The model at a path, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs; null is empty, an empty text has no ids.

    Rows that repeat a doc_id, or have none, each have a row; an empty table gives an empty result; other
    columns are ignored. Texts of any length are encoded whole; time is linear in a text but for the heap's depth.

    Each distinct segment is checked against the library when it is first met in a process, and one whole
    text of each chunk of an Arrow batch is checked end to end, ids and decoded text.
    `path` is looked up on the executors when not given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path or model_path())
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                n, a, b = [], [], []
                for count, ids, decoded in own.both(texts):
                    n.append(count)
                    a.append(sha256(ids).hexdigest())
                    b.append(sha256(decoded).hexdigest())
                probe = texts[0]
                ids = own.library().encode(probe)
                if a[0] != sha256(",".join(map(str, ids)).encode()).hexdigest() or b[0] != sha256(own.library().decode(ids).encode()).hexdigest():
                    raise ValueError("a text's ids or its decoded form differ from the library's")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids themselves and the text that they decode to; rows and edge cases as in digests()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path or model_path())
        for batch in batches:
            for part in chunks(batch, "text"):
                found = list(own.both([x or "" for x in part.column("text").to_pylist()]))
                ids = [np.array(x[1].split(b","), np.int64).tolist() if x[0] else [] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([x[2].decode() for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
