"""Repeated passages by a depth-limited radix sort of suffixes, most significant digits first.

Two suffixes belong together if they agree through `depth` bytes (a window). The sort's first digit is the
window's minimiser, the least hash of the `GRAM`-byte strings in it: equal windows have equal minimisers, so
a digit that one document alone has is settled at once. Neighbouring windows of a text mostly share their
minimiser, so they go through the first two digits as one run: the second digit is a hash of all bytes of the
run. A run that an earlier document has is covered as a whole; a digit that has several different runs goes
on to the last passes, which sort its windows by their bytes, eight at a time, and keep only equal groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, raw, small_batches, sorted_groups

DEPTH = 50
GRAM = 24
SEGMENT = 1 << 20  # windows of a text handled at once
LONGEST = 64  # windows of a run; periodic text, of one minimiser throughout, becomes many equal runs
FLUSH = 1 << 18  # runs that a task gathers before it sends them
_U = np.uint64


def _mix(x: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    x = x * _U(by)
    x ^= x >> _U(29)
    return x


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        n = SEGMENT + 4096
        return tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, b, _U))]) for b in (base, pow(base, -1, 1 << 64)))  # type: ignore[return-value]


def runs(text: bytes, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digit, content, start, stop) of each run of windows with one minimiser; empty if the text is shorter than a window.

    Texts of more than SEGMENT windows are cut into segments; a run ends where its segment does.
    """
    parts = [_segment(np.frombuffer(text, np.uint8, min(SEGMENT + depth - 1, len(text) - a), a), a, depth) for a in range(0, max(0, len(text) - depth + 1), SEGMENT)]
    if not parts:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))  # type: ignore[return-value]


def _segment(b: np.ndarray, at: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = {1: _mix(b.astype(_U) + _U(1))}
    for k in (1, 2, 4, 8):
        grams[2 * k] = _mix(grams[k][:-k] * _U(0xD6E8FEB86659FD93) + grams[k][k:])
    low = _mix(grams[16][:-8] * _U(0xA0761D6478BD642F) + grams[8][16:])  # GRAM bytes
    width, k = depth - GRAM + 1, 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if width > k:
        low = np.minimum(low[: k - width], low[width - k :])
    n = b.size - depth + 1
    low = low[:n]
    start = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
    size = np.diff(np.r_[start, n])
    count = -(-size // LONGEST)
    if count.max() > 1:
        start = np.repeat(start, count) + LONGEST * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    stop = np.r_[start[1:], n]
    power, inverse = _powers()
    eights = grams[8]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(eights * power[: eights.size])])
    content = (sums[stop + depth - 8] - sums[start]) * inverse[start]
    content = _mix(content + _mix((stop - start).astype(_U), 0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3)
    return _mix(_mix(low[start]), 0x94D049BB133111EB), content, start + at, stop + at  # least hashes are small: spread them


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that those which are mostly zero cost nothing once compressed."""
    return x.view(np.uint8).reshape(x.size, x.itemsize).T.tobytes()


def _whole(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, size * n).reshape(size, n).T).view(kind).reshape(n)


def _ranges(digit: np.ndarray, n: int) -> np.ndarray:
    return ((digit >> _U(32)) * _U(n) >> _U(32)).astype(np.int32)


def _by_range(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(place, kind="stable")
    keys, first = np.unique(place[order], return_index=True)
    yield from zip(keys.tolist(), np.split(order, first[1:]), strict=True)


def _requests(batches: Iterator[pa.RecordBatch], parts: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Each run's digits and document, to the range of its first digit.

    What several documents of a task share is sent once, by the first of them; the others are covered, and
    say so (kind 1), so that passages which very many documents share stay small.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch | None:
        if not held:
            return None
        digit, content, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, content))
        digit, content, doc = digit[order], content[order], doc[order]
        new = np.r_[True, content[1:] != content[:-1]]
        own = doc[np.maximum.accumulate(np.where(new, np.arange(new.size), 0))]
        rows = []
        later = doc > own
        if later.any():
            for k, some in _by_range((content[later] % _U(parts)).astype(np.int32)):
                rows.append((k, 1, _planes(content[later][some]) + _planes(doc[later][some])))
        digit, content, doc = digit[new], content[new], doc[new]
        for k, some in _by_range(_ranges(digit, parts)):
            rows.append((k, 0, _planes(digit[some].astype(np.uint32)) + _planes(content[some]) + _planes(doc[some])))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "kind", "data"])

    for batch in batches:
        for piece in chunks(batch, "text"):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), raw(piece, "text"), strict=True):
                if doc_id is None or len(text) < depth:
                    continue
                digit, content, _, _ = runs(text, depth)
                held.append((digit, content, np.full(digit.size, doc_id, np.int64)))
                size += digit.size
                if size >= FLUSH:
                    yield flush()
                    size = 0
    if (last := flush()) is not None:
        yield last


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, content, open): runs that an earlier document has, and (open) runs whose first digit others share."""
    for group in sorted_groups(batches, ["part"]):
        found: list[list[np.ndarray]] = [[], [], []]
        for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True):
            if kind == 1:
                n = len(data) // 16
                yield _answer(_whole(data[8 * n :], np.int64, n), _whole(data, _U, n), np.zeros(n, bool))
            else:
                n = len(data) // 20
                for x, y in zip(found, (_whole(data, np.uint32, n), _whole(data[4 * n :], _U, n), _whole(data[12 * n :], np.int64, n)), strict=True):
                    x.append(y)
        if not found[0]:
            continue
        digit, content, doc = (np.concatenate(x) for x in found)
        order = np.lexsort((doc, content, digit))
        digit, content, doc = digit[order], content[order], doc[order]
        start = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]])
        of = np.repeat(np.arange(start.size), np.diff(np.r_[start, digit.size]))
        shared = (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))[of]
        digit, content, doc, of = digit[shared], content[shared], doc[shared], of[shared]
        if not doc.size:
            continue
        new = np.r_[True, (of[1:] != of[:-1]) | (content[1:] != content[:-1])]
        first = doc[np.maximum.accumulate(np.where(new, np.arange(new.size), 0))]
        later = doc > first
        several = np.bincount(of, new)[of] > 1
        opened = new & several
        some = later | opened
        yield _answer(doc[some], content[some], opened[some])


def _answer(doc: np.ndarray, content: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(content.view(np.int64)), pa.array(opened)], ["doc_id", "content", "open"])


def _opened(batches: Iterator[pa.RecordBatch], parts: int, depth: int) -> Iterator[pa.RecordBatch]:
    """The bytes of open runs, to the range of their first digit."""
    for batch in batches:
        for piece in chunks(batch, "text"):
            rows: dict[int, list[tuple[int, int, bytes]]] = {}
            for doc_id, text, wanted in zip(piece.column("doc_id").to_pylist(), raw(piece, "text"), piece.column("opened"), strict=True):
                if not wanted.is_valid or not len(wanted.values):
                    continue
                digit, content, start, stop = runs(text, depth)
                hit = np.isin(content, wanted.values.to_numpy().view(_U))
                place = _ranges(digit[hit], parts)
                seen = set()
                for k, c, a, b in zip(place.tolist(), content[hit].view(np.int64).tolist(), start[hit].tolist(), stop[hit].tolist(), strict=True):
                    if c not in seen:
                        seen.add(c)
                        rows.setdefault(k, []).append((doc_id, c, text[a : b + depth - 1]))
            if rows:
                keys, data = [], []
                for k, found in rows.items():
                    docs, contents, texts = zip(*found, strict=True)
                    head = [np.array([len(found)], np.int64).tobytes(), _planes(np.array(docs, np.int64)), np.array(contents, np.int64).tobytes(), _planes(np.array([len(t) for t in texts], np.uint32))]
                    keys.append(k)
                    data.append(b"".join([*head, *texts]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


def equal_groups(windows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The least owner of each window's equals. Windows are rows of bytes.

    Sorts by eight bytes in each pass, the most significant first; a pass takes only rows that are still
    equal to another's, and a group in which all rows have one owner is left as it is.
    """
    n, depth = windows.shape
    out = owner.copy()
    rows = np.arange(n)
    group = np.zeros(n, np.int64)
    for a in range(0, depth, 8):
        digit = np.zeros((rows.size, 8), np.uint8)
        digit[:, : min(8, depth - a)] = windows[rows, a : a + 8]
        value = digit.view(">u8").reshape(-1).astype(_U)
        order = np.lexsort((value, group))
        rows, group, value = rows[order], group[order], value[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        own = owner[rows]
        low, high = np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)
        keep = (low < high)[group]
        rows, group = rows[keep], group[keep]
        if not rows.size:
            return out
    own = owner[rows]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    out[rows] = np.repeat(np.minimum.reduceat(own, start), np.diff(np.r_[start, rows.size]))
    return out


def _settled(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, content, low, high): the windows of open runs that an earlier document has."""
    for group in sorted_groups(batches, ["part"]):
        docs, contents, sizes, texts = [], [], [], []
        for data in group.column("data").to_pylist():
            n = int(np.frombuffer(data, np.int64, 1)[0])
            docs.append(_whole(data[8:], np.int64, n))
            contents.append(np.frombuffer(data, np.int64, n, 8 + 8 * n))
            sizes.append(_whole(data[8 + 16 * n :], np.uint32, n).astype(np.int64))
            texts.append(data[8 + 20 * n :])
        doc, content, size = (np.concatenate(x) for x in (docs, contents, sizes))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(size) - size
        count = size - depth + 1
        of = np.repeat(np.arange(doc.size), count)
        offset = np.arange(of.size) - np.repeat(np.cumsum(count) - count, count)
        windows = np.lib.stride_tricks.sliding_window_view(flat, depth)[begin[of] + offset]
        hit = np.flatnonzero(equal_groups(windows, doc[of]) < doc[of])
        if hit.size:
            cut = np.r_[True, (of[hit][1:] != of[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1)]
            first = hit[cut]
            last = hit[np.r_[np.flatnonzero(cut)[1:] - 1, hit.size - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[of[first]]), pa.array(content[of[first]]), pa.array(offset[first].astype(np.int32)), pa.array((offset[last] + 1).astype(np.int32))], ["doc_id", "content", "low", "high"])


def covered(text: bytes, whole: np.ndarray, pieces: list[tuple[int, int, int]], depth: int = DEPTH) -> np.ndarray:
    """Which bytes of a text lie in a covered window, from its covered runs and parts of runs."""
    change = np.zeros(len(text) + 1, np.int64)
    if len(text) >= depth and (whole.size or pieces):
        _, content, start, stop = runs(text, depth)
        content = content.view(np.int64)
        hit = np.isin(content, whole)
        np.add.at(change, start[hit], 1)
        np.add.at(change, stop[hit] + depth - 1, -1)
        if pieces:
            own, low, high = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            order = np.argsort(own, kind="stable")
            own, low, high = own[order], low[order], high[order]
            a, b = np.searchsorted(own, content, "left"), np.searchsorted(own, content, "right")
            for k in np.flatnonzero(b > a).tolist():
                for j in range(int(a[k]), int(b[k])):
                    change[start[k] + low[j]] += 1
                    change[start[k] + high[j] + depth - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch], depth: int, texts: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    for batch in batches:
        for piece in chunks(batch, "text"):
            rows = []
            for doc_id, text, whole, parts in zip(piece.column("doc_id").to_pylist(), raw(piece, "text"), piece.column("whole"), piece.column("parts").to_pylist(), strict=True):
                runs_whole = whole.values.to_numpy() if whole.is_valid else np.zeros(0, np.int64)
                gone = covered(text, runs_whole, [(p["content"], p["low"], p["high"]) for p in parts or ()], depth)
                n = int(gone.sum())
                left = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
                rows.append((doc_id, len(text), n, spans, sha256(left).hexdigest(), *([left] if texts else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)], names)


def remove_repeats(docs: DataFrame, depth: int = DEPTH, parts: int | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs, and with `texts` the kept bytes.

    A byte goes if a window of `depth` bytes (32 or more) that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. Null texts are empty; texts shorter than a window keep
    all. Rows without doc_id keep all and remove nothing. Rows with one doc_id are one document's.
    Runs are compared by 64-bit hashes of their bytes within one minimiser, windows of open runs by bytes.
    The ranges of first digits (`parts`, four for each shuffle partition) are worked on one at a time.
    """
    if depth < GRAM + 8:
        raise ValueError(f"depth must be {GRAM + 8} or more")
    spark = docs.sparkSession
    small_batches(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * shuffles
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = own.mapInArrow(lambda it: _requests(it, parts, depth), "part int, kind int, data binary")
    answers = sent.repartition(shuffles, "part").sortWithinPartitions("part").mapInArrow(_answers, "doc_id long, content long, open boolean")
    by_doc = answers.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("open"), F.col("content"))).alias("whole"),
        F.collect_list(F.when(F.col("open"), F.col("content"))).alias("opened"),
    )
    known = own.join(by_doc.hint("shuffle_hash"), "doc_id", "left")
    bytes_sent = known.select("doc_id", "text", "opened").mapInArrow(lambda it: _opened(it, parts, depth), "part int, data binary")
    settled = bytes_sent.repartition(shuffles, "part").sortWithinPartitions("part").mapInArrow(lambda it: _settled(it, depth), "doc_id long, content long, low int, high int")
    pieces = settled.groupBy("doc_id").agg(F.collect_list(F.struct("content", "low", "high")).alias("parts"))
    both = known.join(pieces.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "whole", "parts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return both.mapInArrow(lambda it: _kept(it, depth, texts), schema)
