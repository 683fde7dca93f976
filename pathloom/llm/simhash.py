"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, forest, forget, private, raw, sorted_groups, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
TILE = 2048


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles; zero for a text without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    h = np.array([digest(view[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, h.size, 1 << 16):  # bounded memory for very long texts
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the signed 64-bit image of each text's fingerprint; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fps = np.array([fingerprint(t, shingle) for t in raw(part, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(distance: int, extra: int) -> list[list[tuple[int, int]]]:
    """Every choice of `extra` of the distance+extra blocks: a pair within `distance` agrees on one whole choice."""
    n = distance + extra
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [list(c) for c in combinations(list(zip(cuts, cuts[1:], strict=False)), extra)]


def _dealt(keyed: DataFrame, member: str, tile: int) -> DataFrame:
    """(key, i, j, member): rows (key, member) of keys that several have; a key of more than `tile` members is
    cut into tiles, and each pair of tiles (i, j) becomes a group of its own: bounded memory, no pair lost."""
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    return _tiled(keyed.join(counted, "key"), member)


def _tiled(keyed: DataFrame, member: str) -> DataFrame:
    """(key, i, j, ...): rows of keys with their number of tiles, one for each pair of tiles that a row is in."""
    dealt = keyed.withColumn("own", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.drop("tiles").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")


def blocks_for(classes: int) -> int:
    """How many blocks a key takes, so that few unlike fingerprints share one: about classes / 2**(key bits) do."""
    return 2 if classes <= 1 << 24 else 3 if classes <= 1 << 30 else 4


def links(classes: DataFrame, distance: int = 4, extra: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links between classes (fp, rep) that connect all whose fingerprints differ in at most `distance` bits.

    Fingerprints are split into distance+extra blocks and keyed by every choice of `extra` blocks. A key
    group becomes a spanning forest, not its pairs, so rows stay linear in the group; a large one is cut
    into tiles as _dealt() has it. The result is the same for every `extra`.
    """
    keys = []
    for k, choice in enumerate(_blocks(distance, extra)):
        bits = F.lit(k).cast("long")
        for a, b in choice:
            bits = F.shiftleft(bits, b - a).bitwiseOR(F.shiftrightunsigned(F.shiftleft("fp", 64 - b), 64 - b + a))
        keys.append(bits)
    dealt = _dealt(classes.select("fp", "rep", F.explode(F.array(*keys)).alias("key")), "fp", tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        for group in sorted_groups(batches, ["key", "i", "j"]):
            fp, rep = (group.column(c).to_numpy() for c in ("fp", "rep"))
            if fp.size == 2:
                pairs = [(0, 1)] if ((int(fp[0]) ^ int(fp[1])) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance else []
            else:
                f = fp.view(np.uint64)
                pairs = forest(f.size, lambda at, rest, f=f: np.bitwise_count(f[rest] ^ f[at]) <= distance)
            left += [int(rep[a]) for a, _ in pairs]
            right += [int(rep[b]) for _, b in pairs]
            if len(left) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": left, "b": right})
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_pydict({"a": left, "b": right})

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Equal fingerprints collapse to their least doc_id before any join, so copies cost one row each. Rows
    that repeat a doc_id each have their own fingerprint and component. Null ids stay as rows, in the
    component of their fingerprint; a null, empty or blank text has fingerprint zero and links like any
    other. An empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("rep", F.col("fp"))
    found = components(links(classes, distance, blocks_for(classes.count())), "a", "b", "simhash")
    rooted = classes.join(found, classes["rep"] == found["node"], "left").select("fp", "low", F.coalesce("component", "rep").alias("root"))
    comps = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(comps, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets -----------------------------------------------------------------

SMALL, BOTH = 32, 40  # a set of fewer than SMALL shingles is compared with sets of fewer than BOTH alone
HOT = 4 * TILE  # classes; a key that more share is replaced by rarer ones, judging them all would take a task seconds
BITS = 16  # of a block of a fingerprint
EVEN = 16  # classes of a block's value that are compared at once with those of other values
CELL = 1 << 17  # shingles that a task holds of a group whose sets it compares, twice
SKETCH = 8  # words of 64 bits
SIEVE = 1 << 26  # bits that are broadcast to tell which rows to send
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], _U)


def _mix(x: np.ndarray, by: np.uint64 = _ODD[2]) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * by
    return x ^ (x >> _U(29))


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles, as fingerprint() makes them; fewer words: the whole sequence."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, _U)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], _U)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    view = memoryview(joined)
    return np.unique(np.array([digest(view[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], _U))


def sketch(h: np.ndarray) -> bytes:
    """SimHash of a set in SKETCH words of 64 bits; one more draw, the same for all, breaks ties."""
    total = np.full((SKETCH, 64), 0, np.int64)
    for k in range(0, h.size, 1 << 14):
        part = h[k : k + (1 << 14)]
        for w in range(SKETCH):
            total[w] += np.unpackbits(_mix(part, _ODD[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    size = h.size
    if size % 2 == 0:
        total += np.unpackbits(_ODD.view(np.uint8), bitorder="little").reshape(SKETCH, 64)
        size += 1
    return np.packbits((total * 2 > size).reshape(-1), bitorder="little").tobytes()


def keys(h: np.ndarray, least: float) -> list[int]:
    """Keys of a small set, too few shingles for a fingerprint: its least hashes, as many as make sure that two
    sets of similarity `least` have one in common. None for a larger set."""
    return _mix(h[: math.floor((1 - least) * h.size + 1e-9) + 1], _ODD[5]).view(np.int64).tolist() if h.size < BOTH else []


_D = np.arange(64 * SKETCH + 1)
_SLACK = 4 * np.sqrt(np.maximum(_D, 1) * (64 * SKETCH - _D) / (64 * SKETCH))
_UP, _DOWN = (_D + _SLACK)[: 32 * SKETCH], np.maximum(_D - _SLACK, 0)


def _jaccard(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sets of sizes a and b whose sketches differ in so many bits."""
    both = np.cos(np.pi * np.clip(distance / (64 * SKETCH), 0, 1)) * np.sqrt(a * b.astype(float))
    return both / np.maximum(a + b - both, 1e-9)


def _bounds(sketches: np.ndarray, n: np.ndarray, at: int, rest: np.ndarray, width: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Similarities that are `width` deviations of the sketch below and above the estimate; sizes alone bound it too.
    _limits() gives the same decisions in bits."""
    d = np.bitwise_count(sketches[rest] ^ sketches[at]).sum(1, dtype=np.int64)
    bits = 64 * SKETCH
    slack = width * np.sqrt(np.maximum(d, 1) * (bits - d) / bits)
    a, b = int(n[at]), n[rest]
    most = np.minimum(a, b) / np.maximum(a, b)
    return _jaccard(d + slack, a, b), np.where(d == 0, most, np.minimum(_jaccard(d - slack, a, b), most))


def _limits(a: int, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """In how many bits the sketches of sets of sizes a and b may differ at most if the sets are alike by four
    deviations of the sketch, and if they may be alike; -1: in none, the sizes alone forbid it."""
    cosine = least * (a + b) / ((1 + least) * np.sqrt(a * b.astype(float)))
    limit = 64 * SKETCH / np.pi * np.arccos(np.minimum(cosine, 1))
    fits = np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9
    return tuple(np.where(fits, np.searchsorted(edge, limit, "right") - 1, -1) for edge in (_UP, _DOWN))


def _sets(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(_a, _b, doc_id, c, n, sig, more, raw, keys) of rows (_a, _b, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for t in raw(part, "text"):
                    h = shingle_set(t, shingle)
                    c = xxhash.xxh64_intdigest(h.tobytes(), SEED) if h.size else 0
                    rows.append((c - (1 << 64) if c >> 63 else c, h.size, sketch(h) if h.size >= SMALL else None, sketch(_mix(h, _ODD[4])) if h.size >= SMALL else None, h.tobytes() if h.size < BOTH else None, keys(h, least)))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), part.column("doc_id"), *columns], ["a", "b", "doc_id", "c", "n", "sig", "more", "raw", "keys"])

    return docs.mapInArrow(run, "a long, b int, doc_id long, c long, n long, sig binary, more binary, raw binary, keys array<long>")


def _small_pairs(group: pa.Table, least: float) -> list[tuple[int, int]]:
    """Forest of the sets in a group that are alike, from their hashes."""
    n = group.column("n").to_numpy()
    table = np.zeros((n.size, BOTH), _U)
    for k, x in enumerate(group.column("raw").to_pylist()):
        table[k, : n[k]] = np.frombuffer(x, _U)
    valid = np.arange(BOTH) < n[:, None]

    def near(at: int, rest: np.ndarray) -> np.ndarray:
        both = (np.isin(table[rest], table[at, : n[at]]) & valid[rest]).sum(1)
        return both >= least * (n[at] + n[rest] - both) - 1e-9

    return forest(n.size, near)


class _Sketches:
    """The sketches and sizes of some sets, compared row by row."""

    def __init__(self, group: pa.Table, least: float):
        self.n = group.column("n").to_numpy()
        self.bits = np.ascontiguousarray(np.frombuffer(b"".join(group.column("sig").to_pylist()), _U).reshape(-1, SKETCH).T)
        self.sizes, self.place = np.unique(self.n, return_inverse=True)
        self.least = least

    def apart(self, at: int, rest: np.ndarray | slice) -> np.ndarray:
        return np.bitwise_count(self.bits[:, rest] ^ self.bits[:, at, None]).sum(0, dtype=np.int16)

    def sure(self, at: int, rest: np.ndarray) -> np.ndarray:
        return self.apart(at, rest) <= _limits(int(self.n[at]), self.sizes, self.least)[0][self.place[rest]]

    def may(self, at: int, rest: np.ndarray) -> np.ndarray:
        return self.apart(at, rest) <= _limits(int(self.n[at]), self.sizes, self.least)[1][self.place[rest]]


def _large_pairs(group: pa.Table, least: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(sure, open): a forest of the pairs that their sketches prove alike; where it leaves several trees, also
    one of all pairs that may be alike. Both are linear in the group."""
    near = _Sketches(group, least)
    sure = forest(near.n.size, near.sure)
    return sure, forest(near.n.size, near.may) if len(sure) < near.n.size - 1 else []


def _judged(dealt: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, sure): edges between classes of one group (key, i, j, c) that connect all that are alike (sure), and
    all that may be (not sure)."""
    joined = dealt.select("key", "i", "j", "c").join(classes.select("c", "n", "sig", "raw"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "i", "j"]):
            small, large = group.filter(group.column("raw").is_valid()), group.filter(group.column("sig").is_valid())
            found = []
            if small.num_rows > 1:
                found.append((small, _small_pairs(small, least), True))
            if large.num_rows > 1:
                sure, left = _large_pairs(large, least)
                found += [(large, sure, True), (large, left, False)]
            for rows, pairs, flag in found:
                if pairs:
                    a, b = rows.column("c").to_numpy()[np.array(pairs).T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(a.size, flag))], ["a", "b", "sure"])

    # many groups are little data and much work: AQE, which goes by bytes, would put them into few tasks
    return joined.repartition(_tasks(classes), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long, sure boolean")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's blocks, numbered: the block's place above its BITS bits, by the two fingerprints of 512 bits."""
    words = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig", "more")]
    value = np.concatenate(words, 1).astype(np.int32)
    return (np.arange(value.shape[1], dtype=np.int32) << BITS) + value


def _widest(bits: int, least: float) -> int:
    """In how many bits fingerprints of `bits` bits may differ at most, if the sets may be alike by four deviations."""
    d = np.arange(bits // 2)
    slack = 4 * np.sqrt(np.maximum(d, 1) * (bits - d) / bits)
    return int(np.searchsorted(np.maximum(d - slack, 0), bits / np.pi * np.arccos(2 * least / (1 + least)), "right")) - 1


def _touched(start: np.ndarray, x: np.ndarray, y: np.ndarray, widest: int) -> np.ndarray:
    """Which rows differ from another one of their group in at most `widest` bits of x and y; groups begin at `start`."""
    size = np.diff(np.r_[start, x.size])
    out = np.zeros(x.size, bool)
    even = np.repeat(size <= EVEN, size)
    to_end = np.repeat(start + size, size) - np.arange(x.size)
    for shift in range(1, min(EVEN, int(size.max()))):
        at = np.flatnonzero(even & (to_end > shift))
        at = at[np.bitwise_count(x[at] ^ x[at + shift]) + np.bitwise_count(y[at] ^ y[at + shift]) <= widest]
        out[at] = out[at + shift] = True
    for k in np.flatnonzero(size > EVEN):
        u, v = (w[start[k] : start[k] + size[k]] for w in (x, y))
        if u.size <= 1024:
            hit = (np.bitwise_count(u[:, None] ^ u) + np.bitwise_count(v[:, None] ^ v) <= widest).sum(1) > 1  # itself is one
        else:
            pairs = forest(u.size, lambda at, rest, u=u, v=v: np.bitwise_count(u[rest] ^ u[at]) + np.bitwise_count(v[rest] ^ v[at]) <= widest)
            hit = np.isin(np.arange(u.size), np.array(pairs, np.int64))
        out[start[k] : start[k] + size[k]] = hit
    return out


def _pigeonholes(classes: DataFrame, tile: int, hot: int, least: float = 0.8) -> DataFrame:
    """(key, i, j, c, n, sig): groups of classes that share one of the 64 blocks of their fingerprints and that may be
    alike with one more of the group, by 128 bits of the other fingerprint.

    Only these two words go with each block; sketches are sent to the groups that are left, and those of the same
    classes are one. A block's value of more than about `hot` classes is cut into tiles of `tile`, and each two of
    them meet: no pair is lost.
    """
    large = classes.where("sig is not null").select("c", "n", "sig", "more")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                value = _values(batch)
                other = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.int64).reshape(batch.num_rows, -1) for x in ("more", "sig")]
                x, y = (np.repeat(np.stack([w[:, at] for w in other], 1), value.shape[1] // 2, 1).reshape(-1) for at in (0, 1))
                c = np.repeat(batch.column("c").to_numpy(), value.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (value.reshape(-1), c, x, y)], ["key", "c", "x", "y"])

    rare = max(1, hot // (2 * _tasks(classes)))  # in one task; others are too rare to be hot

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * 64 * SKETCH // BITS) << BITS, np.int32)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_values(batch).reshape(-1), minlength=total.size).astype(np.int32)
        at = np.flatnonzero(total >= rare)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["key", "m"])

    widest = _widest(128, least)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["key", "i", "j"]):
            key = np.stack([rows.column(x).to_numpy() for x in ("key", "i", "j")])
            start = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]
            c, x, y = (rows.column(w).to_numpy().view(_U) for w in ("c", "x", "y"))
            hit = _touched(start, x, y, widest)
            same = _mix(np.add.reduceat(np.where(hit, _mix(c), _U(0)), start))  # of equal sets of classes; others meet by chance alone, which adds work
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(same[np.searchsorted(start, at, "right") - 1].view(np.int64)), pa.array(c[at].view(np.int64))], ["key", "c"])

    dealt = large.mapInArrow(deal, "key int, c long, x long, y long")
    often = written(large.select("sig", "more").mapInArrow(count, "key int, m long").groupBy("key").agg(F.sum("m").alias("m")).where(F.col("m") > hot), "hot-blocks")
    if often.isEmpty():
        dealt = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        tiles = F.coalesce(F.ceil(F.col("m") / tile).cast("int"), F.lit(1))
        dealt = _tiled(dealt.join(F.broadcast(often), "key", "left").withColumn("tiles", tiles).drop("m"), "c")
    sorted_ = dealt.repartition(_tasks(classes), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    left = sorted_.mapInArrow(met, "key long, c long").distinct()
    return left.join(large.select("c", "n", "sig"), "c").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "c", "n", "sig")


def _near(pigeonholes: DataFrame, least: float, tasks: int) -> DataFrame:
    """(a, b, sure): edges between classes that share a block and whose fingerprints differ in few enough bits to be
    alike (sure), or perhaps alike (not sure); enough of them to connect all such classes of a group."""
    widest = int(_limits(1, np.ones(1, np.int64), least)[1][0])

    def pairs_of(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of small groups, compared at once, then forests of the larger ones."""
        key = np.stack([group.column(x).to_numpy() for x in ("key", "i", "j")])
        n, c = group.column("n").to_numpy(), group.column("c").to_numpy()
        bits = np.frombuffer(b"".join(group.column("sig").to_pylist()), _U).reshape(-1, SKETCH)
        start = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, n.size]
        size = np.diff(start)
        even = np.repeat(size <= EVEN, size)
        to_end = np.repeat(start[1:], size) - np.arange(n.size)
        for shift in range(1, min(EVEN, int(size.max()))):
            at = np.flatnonzero(even & (to_end > shift))
            d = np.bitwise_count(bits[at] ^ bits[at + shift]).sum(1, dtype=np.int16)
            at, d = at[d <= widest], d[d <= widest]
            sure, may = _limits(n[at], n[at + shift], least)
            yield c[at[d <= may]], c[at[d <= may] + shift], (d <= sure)[d <= may]
        for k in np.flatnonzero(size > EVEN):
            own = slice(start[k], start[k + 1])
            for found, flag in zip(_large_pairs(group.slice(int(start[k]), int(size[k])), least), (True, False), strict=True):
                if found:
                    x, y = c[own][np.array(found).T]
                    yield x, y, np.full(x.size, flag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, ["key", "i", "j"]):
            found = list(pairs_of(group))
            a, b, sure = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure.astype(bool))], ["a", "b", "sure"])

    return pigeonholes.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long, sure boolean")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows or more from batches sorted by keys; no group is in two of them."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(batch)
        if sum(x.num_rows for x in kept) < rows:
            continue
        now = pa.Table.from_batches(kept)
        columns = [now.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if cuts.size:
            end = int(cuts[-1]) + 1
            yield now.slice(0, end)
            kept = now.slice(end).combine_chunks().to_batches()
        else:
            kept = now.combine_chunks().to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _compared(found: DataFrame, known: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, least: float, size: int) -> DataFrame:
    """(a, b): edges between alike classes, by whole sets, that connect what the sketches left open.

    Classes that edges of `found` (a, b) connect, open ones included, and that are not one component of
    `known` (node, component) yet, meet in a group with their whole sets; no pair is sent. There, pairs of
    different components that may be alike are compared, likest first, unless those before them connect them.
    A group of more than `size` shingles is cut into tiles; each two of them meet.
    """
    wide = components(found, "a", "b", "open").select(F.col("node").alias("c"), F.col("component").alias("key"))
    roots = known.select(F.col("node").alias("c"), F.col("component").alias("root"))
    members = wide.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")).join(classes.where("sig is not null").select("c", "n", "sig"), "c")
    open_ = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("n") / size).cast("int").alias("tiles"))
    members = written(members.join(open_.where("low <> high").select("key", "tiles"), "key"), "open-classes")
    whole = members.join(_hashes(classes.join(members.select("c"), "c"), texts, shingle), "c")
    dealt = _tiled(whole, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "i", "j"]):
            pairs = _compare(group, least)
            if pairs:
                a, b = np.array(pairs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition(_tasks(classes), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _compare(group: pa.Table, least: float) -> list[tuple[int, int]]:
    """Alike pairs of one cell of _compared(), enough to connect its components."""
    near = _Sketches(group, least)
    c, n = group.column("c").to_numpy(), near.n
    start, root = np.unique(group.column("root").to_numpy(), return_inverse=True)
    left, bits = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int16)]
    for at in range(n.size - 1):
        rest = at + 1 + np.flatnonzero(root[at + 1 :] != root[at])
        if rest.size:
            d = near.apart(at, rest)
            hit = d <= _limits(int(n[at]), near.sizes, least)[1][near.place[rest]]
            left.append(np.stack([np.full(int(hit.sum()), at), rest[hit]]))
            bits.append(d[hit])
    pairs, d = np.concatenate(left, 1), np.concatenate(bits)
    pairs = pairs[:, np.argsort(-_jaccard(d, n[pairs[0]], n[pairs[1]]), kind="stable")]
    sets = [h.values.to_numpy().view(_U) for h in group.column("h")]
    up = list(range(start.size))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for a, b in pairs.T.tolist():
        u, v = find(int(root[a])), find(int(root[b]))
        if u != v:
            both = np.intersect1d(sets[a], sets[b], assume_unique=True).size
            if both >= least * (sets[a].size + sets[b].size - both) - 1e-9:
                up[u] = v
                out.append((int(c[a]), int(c[b])))
    return out


def _alike(classes: DataFrame, texts: DataFrame, shingle: int, least: float, tile: int, hot: int) -> DataFrame:
    """(a, b, sure): edges between classes (c, n, sig, more, raw, keys) that share a block of their fingerprints, or a
    key of small sets, and are alike, or may be (not sure).

    A key of more than `hot` classes (a passage that very many texts share makes such keys) is not worked on
    as it is. Pairs that share one are found by an exact prefix filter over the classes with such keys:
    shingles are ordered by how many of these classes have them, rarest first, and each class is keyed by as
    many of its first as make sure that two sets of similarity `least` have one in common. A passage's
    shingles come last in that order, so texts that share no more than it do not meet.
    """
    keyed = classes.select(F.explode("keys").alias("key"), "c")
    counted = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "set-keys")
    cool = keyed.join(counted.where(F.col("m") <= hot), "key").select("key", "c", F.lit(0).alias("i"), F.lit(0).alias("j"))
    found = _judged(cool, classes, least)
    often = counted.where(F.col("m") > hot)
    if not often.isEmpty():
        ids = keyed.join(often, "key").select("c").distinct()
        whole = written(_hashes(classes.join(ids, "c"), texts, shingle), "hot-sets")
        each = whole.select("c", F.size("h").alias("n"), F.explode("h").alias("key"))
        ranked = each.join(each.groupBy("key").agg(F.count("*").alias("m")), "key")
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("m", "key")))  # one class's shingles
        prefix = ranked.where((F.col("m") > 1) & (F.col("place") <= F.floor((1 - least) * F.col("n") + 1e-9) + 1)).select("key", "c")
        found = found.unionByName(_judged(_dealt(prefix, "c", tile), classes, least))
    found = found.unionByName(_near(_pigeonholes(classes, tile, hot, least), least, _tasks(classes)))
    return found.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _hashes(classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(c, h): the whole shingle sets of classes, from one text of each."""
    own = written(classes.select("c", F.col("row.a").alias("a"), F.col("row.b").alias("b")), "set-rows")  # of known size
    some = _sieved(texts, own, "a", "b", "_some").where("_some").drop("_some")
    return some.join(own, ["a", "b"]).dropDuplicates(["c"]).select("c", "text").mapInArrow(lambda it: _whole(it, shingle), "c long, h array<long>")


def _sieved(rows: DataFrame, ids: DataFrame, a: str, b: str, mark: str) -> DataFrame:
    """rows with a column `mark`: true where their identity (a, b) is among ids (a, b), and in few other rows.

    A bitmap of ids is broadcast, so that no text is shuffled to be dropped. It has 16 bits or more for each of ids, but
    SIEVE at most: a fuller one marks more rows, and never fewer than those of ids.
    """
    bits = min(SIEVE, 1 << (16 * ids.count() + 63).bit_length())
    word, held = private(rows, "_word"), private(rows, "_held")
    place = f"(`{{}}` & {bits - 1}L)"
    own, other = place.format("a"), place.format(a)
    words = ids.groupBy(F.expr(f"shiftright({own}, 6)").alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({own} & 63 as int))")).alias(held))
    found = rows.withColumn(word, F.expr(f"shiftright({other}, 6)")).join(F.broadcast(written(words, "sieve")), word, "left")
    return found.withColumn(mark, F.expr(f"coalesce(shiftright(`{held}`, cast({other} & 63 as int)) & 1 = 1, false)")).drop(word, held)


def _identified(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with 96 bits of hash over all of a row's columns (maps left out), and the two columns' names."""
    a, b = private(docs, "_row_a"), private(docs, "_row_b")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return docs.withColumns({a: F.xxhash64(*plain), b: F.hash(*plain)}), a, b


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, tile: int = TILE, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """(a, b, doc_id, c, component): for each row of docs its identity (a, b), class and component of classes.

    Rows with equal sets of word shingles are one class; classes whose sets have a Jaccard similarity of
    `least` or more are linked. Candidates share one of the 64 blocks of 16 bits of SimHashes of 1024 bits: all
    that differ in fewer than 64 bits do, and of pairs at similarity 0.8 (155 bits differ) 99 % as reckoned, at 0.85
    all but 1 in 1,000. 128 bits rule out most others where they meet, with the same margin of four deviations as all
    that follows. The Hamming distance in 512 of the bits decides pairs that are four deviations or more from
    the limit; all others are compared by their whole sets. Sets of fewer than 32 shingles, too few for a
    fingerprint, meet by keys() and are compared whole.
    """
    marked, a, b = _identified(docs)
    texts = marked.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_sets(texts, shingle, least), "sets")
    classes = written(rows.groupBy("c").agg(F.min(F.struct("a", "b")).alias("row"), *[F.first(x).alias(x) for x in ("n", "sig", "more", "raw", "keys")]), "set-classes")
    found = written(_alike(classes, texts, shingle, least, tile, hot), "set-links")
    sure = found.where("sure").select("a", "b")
    left = found.where("not sure")
    comps = components(sure, "a", "b", "sets")
    if not left.isEmpty():
        more = written(_compared(found, comps, classes, texts, shingle, least, cell), "set-more")
        if not more.isEmpty():
            roots = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
            comps = components(roots.unionByName(more), "a", "b", "sets")
    forget(found)
    return rows.select("a", "b", "doc_id", "c").join(comps.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))


def _whole(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("c"), pa.array([shingle_set(t, shingle).view(np.int64) for t in raw(part, "text")], pa.list_(pa.int64()))], ["c", "h"])


def unique(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar(): that of the least doc_id, then of the least row hash.

    Rows are told apart by all their columns, never by doc_id alone: of rows that share a doc_id, those with
    different texts are different documents, and of rows equal in every column one stays. Rows without a
    doc_id come after those with one. Null, empty and blank texts are one class. An empty table stays empty.
    """
    found = similar(docs, shingle, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    won = found.groupBy("component").agg(F.min(order).alias("o")).select("o.a", "o.b", F.lit(True).alias("won"))
    counted = found.groupBy("a", "b").agg(F.count("*").alias("n")).join(won, ["a", "b"], "left")
    judged = written(counted.where("won is null or n > 1"), "judged")  # all others stay as they are, and their texts where they are
    marked, a, b = _identified(docs)
    mark = private(docs, "_judged")
    some = _sieved(marked, judged, a, b, mark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = judged.select(F.col("a").alias(a), F.col("b").alias(b), "won")
    once = some.where(~F.col(mark)).select(*columns).unionByName(some.where(F.col(mark)).join(named, [a, b], "left_anti").select(*columns))
    if judged.where("won").isEmpty():
        return once
    whole = private(docs, "_whole")
    repeated = some.where(F.col(mark)).join(named.where("won"), [a, b], "left_semi")
    return once.unionByName(repeated.groupBy(a, b).agg(F.first(F.struct(*columns)).alias(whole)).select(f"{whole}.*"))
