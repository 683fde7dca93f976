"""Toxicity by compression distance: the same window under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold

TOXIC_SAMPLE, ORDINARY_SAMPLE = 2500, 5000
WINDOWS = 60_000  # of eight words, that the ordinary dictionary is trained on
SIZE = 32768  # bytes of the ordinary dictionary; the toxic one may have four times as many
_CLEAN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_SPELLED = [sha256(bytes([c])).digest()[:3] for c in range(256)]  # a byte as three, so that short words weigh enough
_STEPS = (1, 2, 4, 6, 8, 10, 12)
_RATIOS = (0.25, 0.4, 0.5, 0.6)
_KEPT = 300_000
_SAVINGS: dict[bytes, dict[bytes, int]] = {}  # of the dictionaries in use; a worker keeps no others'


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_CLEAN).split()


def _window(word: bytes) -> bytes:
    return b"".join([_SPELLED[c] for c in b" " + word + b" "])


class Dictionaries:
    """Two dictionaries, trained on windows of ordinary and of toxic text; a window is compressed with the first, and with both.

    Both ways share the ordinary part, so ordinary windows cost the same under either, and what a window saves
    under the toxic dictionary measures how near it is to toxic text.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._open()

    def _open(self) -> None:
        how = dict(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        self._size = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_FULLDICT), compression_params=zstandard.ZstdCompressionParameters(**how)).compress for x in (self.ordinary, self.ordinary + self.toxic)]
        self._key = sha256(b"%d:" % len(self.ordinary) + self.ordinary + self.toxic).digest()

    def __getstate__(self) -> tuple[bytes, bytes]:
        return self.ordinary, self.toxic

    def __setstate__(self, state: tuple[bytes, bytes]) -> None:
        self.__init__(*state)

    def savings(self, found: list[bytes]) -> np.ndarray:
        """(bytes saved, size under the ordinary dictionary) of each window."""
        if self._key not in _SAVINGS:
            _SAVINGS.clear()
            _SAVINGS[self._key] = {}
        known = _SAVINGS[self._key]
        if len(known) > _KEPT:
            known.clear()
        first, second = self._size
        out = []
        for w in found:
            v = known.get(w)
            if v is None:
                window = _window(w)
                size = len(first(window))
                v = known[w] = size << 16 | max(0, size - len(second(window)))
            out.append(v)
        x = np.array(out, np.int64)
        return np.stack([x & 0xFFFF, x >> 16])

    def features(self, found: list[bytes]) -> np.ndarray:
        """Counts and shares of a text's windows that save so much."""
        if not found:
            return np.zeros(2 * len(_STEPS) + 2 * len(_RATIOS) + 5)
        saved, size = self.savings(found)
        ratio = saved / np.maximum(1, size - 9)  # without the frame
        at = [(saved >= s).sum() for s in _STEPS] + [((ratio >= r) & (saved >= 2)).sum() for r in _RATIOS]
        x = np.array(at, float)
        best = np.sort(saved)[-5:]
        return np.concatenate([np.log1p(x), np.sqrt(x / saved.size), [saved.max(), best.mean(), np.sqrt(np.maximum(saved - 1, 0).mean()), np.log1p(saved.size), ratio.max()]])


def trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """A dictionary that zstandard trains on the samples, of segments of about so many bytes; b"" where they are too few."""
    for want in (size, size // 4, size // 16, 1024, 512, 256):
        try:
            return zstandard.train_dictionary(want, samples, k=segment, d=match).as_bytes()
        except zstandard.ZstdError:
            continue
    return b""


def typical(toxic: list[list[bytes]], ordinary: list[list[bytes]], odds: float = 8.0, texts: int = 3) -> list[bytes]:
    """The windows of toxic texts that a toxic dictionary is to hold: met in `texts` of them or more, at `odds` or
    more against ordinary texts, at most 64 bytes; as often as toxic texts have them, up to 50 times."""
    plus, minus = Counter(w for t in toxic for w in set(t)), Counter(w for t in ordinary for w in set(t))
    share = lambda w, c: c / max(1, len(toxic)) / ((minus[w] + 0.3) / max(1, len(ordinary)))
    return [_window(w) for w, c in sorted(plus.items()) if c >= texts and len(w) <= 64 and share(w, c) > odds for _ in range(c)]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int = SIZE, seed: int = 0, windows: int = WINDOWS) -> Dictionaries:
    """zstandard trains both: the ordinary dictionary on at most `windows` windows of eight words of ordinary
    texts drawn at random, the toxic one on the windows that are typical() of toxic texts, in pairs. They have at
    most `size` and 4 * `size` bytes."""
    rng = np.random.default_rng(seed)
    many = [b"".join(_window(w)[3:] for w in t[i : i + 8]) for t in ordinary for i in range(0, len(t), 8)]
    many = [many[i] for i in rng.permutation(len(many))[:windows]]
    plain = [(b"%d " % i) * 8 for i in range(2000)]  # where there is too little text to train on
    own = typical(toxic, ordinary)
    own = [b"".join(own[i] for i in part) for part in np.array_split(rng.permutation(len(own)), max(1, len(own) // 2))] if own else []
    return Dictionaries(trained(many, size, 200, 8) or trained(plain, 1024, 200, 8), trained(own, 4 * size, 256, 6))


class Model:
    """Dictionaries and a calibrated logistic score on the features."""

    def __init__(self, dictionaries: Dictionaries, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.dictionaries, self.mean, self.scale, self.weights, self.bias = dictionaries, mean, scale, weights, bias

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.dictionaries.features(words(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def fit(toxic: list[str], ordinary: list[str], share: float, folds: int = 4, windows: int = WINDOWS, size: int = SIZE) -> Model:
    """Calibrate on features from dictionaries that have not seen the text, then train the dictionaries on all.

    `share` is the share of toxic texts among labelled ones, to which the score is calibrated.
    """
    plus, minus = [words(t) for t in toxic], [words(t) for t in ordinary]
    rows, y = [], []
    for k in range(folds):
        own = train_dictionaries([t for i, t in enumerate(plus) if i % folds != k], [t for i, t in enumerate(minus) if i % folds != k], size, windows=windows)
        rows += [own.features(t) for t in plus[k::folds]] + [own.features(t) for t in minus[k::folds]]
        y += [1.0] * len(plus[k::folds]) + [0.0] * len(minus[k::folds])
    x, target = np.array(rows), np.array(y)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.where(target == 1, share / max(1, len(plus)), (1 - share) / max(1, len(minus))) * len(x)
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 2.0)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - target)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(train_dictionaries(plus, minus, size, windows=windows), mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE, text_bytes: int = 16384, windows: int = WINDOWS, size: int = SIZE) -> Model | None:
    """Fit on at most the given numbers of labelled texts of the learning folds, drawn by least hash of doc_id.

    The bounds are for fitting alone: of a text longer than `text_bytes` characters a random run of that
    length is learned from, and train_dictionaries() keeps to `windows` and `size`; scoring uses whole texts. None where a class has no text.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", 4) != 2)).select("doc_id", "toxic").distinct()
    share = own.agg(F.avg("toxic").alias("p")).first()["p"]
    if not share or share >= 1:
        return None
    by_hash = F.xxhash64("doc_id")
    picked = own.where("toxic = 1").orderBy(by_hash, "doc_id").limit(toxic_sample).unionByName(own.where("toxic = 0").orderBy(by_hash, "doc_id").limit(ordinary_sample))
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - text_bytes, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.col("text").substr(start, F.lit(text_bytes)).alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    texts = {k: [r["text"] for r in rows if r["toxic"] == k] for k in (0, 1)}
    return fit(texts[1], texts[0], float(share), windows=windows, size=size) if texts[0] and texts[1] else None


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, null as empty; without a model every score is 0.

    Whole texts are scored, empty ones too. Rows that repeat a doc_id each have a row; a null doc_id is not
    held out and not learned from; an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, labels)
    if model is None:
        scored = texts.select("doc_id", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for part in chunks(batch, "text"):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score([t or "" for t in part.column("text").to_pylist()]))], ["doc_id", "score"])

        scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
