"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, over letters in lower case with every run of other
characters as one space. A model is sorted arrays of n-gram hashes, one array for each order, with
the discounted probabilities beside them, and the same for contexts with their back-off weights; a lookup is a
binary search. The language with the lowest cross-entropy per character wins. A text is rejected
if even that cross-entropy lies beyond what held-back training texts of the language show: their
median, plus a margin, plus a spread that shrinks with the square root of the text's length.

Training takes a bounded sample: at most about `MOST_DOCS` documents and `MOST_CHARS` characters for each
language (both are parameters of `train`), chosen by hash of the id. Prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .shingles import mixed

ORDER = 4
MOST_DOCS, MOST_CHARS = 600, 1_500_000
#: Of the sample, one document in so many calibrates instead of training.
HELD_BACK = 5
MARGIN, SPREADS = 1.0, 6.0
SPACE, ASTRAL = 32, 0xFFFF
SYMBOLS = 1 << 16
#: Symbols and texts that a task looks at together: a worker's memory stays small.
_PART, _TEXTS = 1 << 18, 512


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: itself for a letter, a space for all else."""
    codes = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in codes.tolist()), bool, len(codes))
    return np.where(letter, np.minimum(codes, ASTRAL), SPACE).astype(np.uint16)


def symbols(text: str) -> np.ndarray:
    """A text's symbols; runs of non-letters are one space, none at the edges. Empty if there is no letter."""
    s = _symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = s == SPACE
    if len(s):
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        s = s[keep]
    while len(s) and s[0] == SPACE:
        s = s[1:]
    return s[:-1] if len(s) and s[-1] == SPACE else s


def grams(s: np.ndarray) -> np.ndarray:
    """For each symbol, and a space at the end, the key of the 4-gram that ends there: 16 bits each, the last symbol lowest."""
    padded = np.concatenate([np.full(ORDER - 1, SPACE, np.uint64), s.astype(np.uint64), np.full(1, SPACE, np.uint64)])
    n = len(s) + 1
    key = np.zeros(n, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(16)) | padded[i : i + n]
    return key


def _low(key: np.ndarray, n: int) -> np.ndarray:
    return key if n == ORDER else key & np.uint64((1 << (16 * n)) - 1)


def _hash(key: np.ndarray, n: int) -> np.ndarray:
    return mixed(key + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


@dataclass
class Model:
    """Per order: sorted gram hashes with discounted probabilities, sorted context hashes with weights."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), 1.0 / SYMBOLS)
        for n in range(1, ORDER + 1):
            p = _find(*self.grams[n - 1], _hash(_low(key, n), n), 0.0) + _find(*self.contexts[n - 1], _hash(_low(key, n) >> np.uint64(16), n), 1.0) * p
        return np.log(p)


def _find(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(hashes):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, values[at].astype(np.float64), default)


def fit(keys: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from the 4-gram keys of all training texts of a language.

    The highest order has counts; lower orders count the distinct symbols that go before. Every
    order has its own discount n1 / (n1 + 2 n2).
    """
    model = Model()
    gram, count = np.unique(keys, return_counts=True)
    levels = [(gram, count)]
    for n in range(ORDER - 1, 0, -1):
        levels.append(np.unique(_low(levels[-1][0], n), return_counts=True))
    for n, (g, c) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        ctx, inverse = np.unique(g >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(inverse, weights=c), np.bincount(inverse)
        for name, h, v in (("grams", _hash(g, n), (c - discount) / total[inverse]), ("contexts", _hash(ctx, n), discount * kinds / total)):
            order = np.argsort(h)
            getattr(model, name).append((h[order], v[order].astype(np.float32)))
    return model


@dataclass
class Languages:
    """Models by language, in the order of their names, and the limits of rejection."""

    names: list[str]
    models: list[Model]
    #: by language: median cross-entropy, and the spread of (cross-entropy - median) * sqrt(length)
    limits: list[tuple[float, float]]
    temperature: float = 1.0


class _Scorer:
    """Log probabilities under every model; those of frequent 4-grams are kept in a table with fixed places."""

    def __init__(self, languages: Languages):
        self.languages, n = languages, max(1, len(languages.names))
        self.bits = max(10, min(19, int(np.log2((24 << 20) / (4 * n)))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros((1 << self.bits, n), np.float32)

    def _fresh(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([m.log_probs(keys) for m in self.languages.models], axis=1).astype(np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (texts x languages) and number of symbols; texts without letters have 0 symbols."""
        sums, lengths = np.zeros((len(texts), len(self.languages.names))), np.zeros(len(texts), np.int64)
        pending, size = [], 0
        for i, text in enumerate(texts):
            s = symbols(text) if text else np.zeros(0, np.uint16)
            lengths[i] = len(s)
            if len(s):
                key = grams(s)
                for lo in range(0, len(key), _PART):
                    pending.append((i, key[lo : lo + _PART]))
                    size += len(pending[-1][1])
                    if size >= _PART:
                        self._add(pending, sums)
                        pending, size = [], 0
        self._add(pending, sums)
        return -sums / np.maximum(lengths + 1, 1)[:, None], lengths

    def _add(self, pending: list[tuple[int, np.ndarray]], sums: np.ndarray) -> None:
        if not pending:
            return
        key = np.concatenate([k for _, k in pending])
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        miss = self.keys[slot] != key
        if miss.any():
            new = np.unique(key[miss])
            rows = self._fresh(new)
            at = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
            self.keys[at], self.rows[at] = new, rows
        values = self.rows[slot]
        if miss.any() and (still := np.flatnonzero(self.keys[slot] != key)).size:
            # keys that share a place with a newer one
            rest, inverse = np.unique(key[still], return_inverse=True)
            values[still] = self._fresh(rest)[inverse]
        starts = np.cumsum([0, *(len(k) for _, k in pending[:-1])])
        np.add.at(sums, [i for i, _ in pending], np.add.reduceat(values, starts, axis=0, dtype=np.float64))


def _train_one(most_chars: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        import pickle

        rows = sorted(zip(group["h"].to_pylist(), group["text"].to_pylist(), strict=True))
        parts, size = [], 0
        for _, text in rows:
            if size >= most_chars:
                break
            s = symbols(text)
            if len(s):
                parts.append(grams(s))
                size += len(s)
        if not parts:
            return pa.table({"lang": pa.array([], pa.string()), "model": pa.array([], pa.binary())})
        return pa.table({"lang": [key[0].as_py()], "model": pa.array([pickle.dumps(fit(np.concatenate(parts)))], pa.binary())})

    return run


def may_train(id_col: str = "doc_id") -> F.Column:
    """Whether a document is not held out: crc32 of its id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS, most_chars: int = MOST_CHARS) -> Languages:
    """Models from a bounded sample of the documents that may train and have text and language.

    The sample takes the documents whose hash lies below a threshold that leaves about `most_docs` of
    each language, and of those the first by hash that reach `most_chars` characters. It passes by the executors, one
    task for each language; a model has at most 64 bytes for each character of the sample, and models come to the
    driver. A language whose training texts have no letter has no model. Rows that repeat a document weigh
    as often; rows with a null id, text or language do not train; an empty table gives no models.
    """
    import pickle

    usable = docs.filter(may_train(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    back = F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(HELD_BACK)) == 0
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~back).alias("free")).collect()
    n = {r["lang"]: r["n"] for r in found}
    if not n:
        return Languages([], [], [])
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, most_docs / v))])
    sample = rows.filter(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.element_at(share, F.col("lang")))
    # a language with few documents trains on all of them, and its limits are those of the others
    enough = [r["lang"] for r in found if min(most_docs, r["n"]) >= 2 * HELD_BACK and r["free"]]
    if sum(min(most_docs, v) for v in n.values()) >= 10 * HELD_BACK and enough:
        back = back & F.col("lang").isin(enough)
        learn = sample.filter(~back)
    else:
        learn = sample
    cut = learn.withColumn("text", F.substring("text", 1, most_chars))  # a text that is longer is the whole sample of its language
    models = {r["lang"]: pickle.loads(r["model"]) for r in cut.groupBy("lang").applyInArrow(_train_one(most_chars), "lang string, model binary").collect()}
    names = sorted(models)
    out = Languages(names, [models[k] for k in names], [(0.0, float("inf"))] * len(names))
    if not names:
        return out
    kinds = ", ".join(f"e{i} double" for i in range(len(names)))
    rows = sample.filter(back).select("lang", "text").mapInArrow(_entropies(out), f"lang string, n long, {kinds}").collect()
    return calibrated(out, [(r[0], r[1], list(r[2:])) for r in rows if r[1]])


def _entropies(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(languages)
        for batch in batches:
            e, n = score(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *(pa.array(c) for c in e.T)], names=["lang", "n", *(f"e{i}" for i in range(e.shape[1]))])

    return run


def calibrated(languages: Languages, rows: list[tuple[str, int, list[float]]]) -> Languages:
    """Set the limits of rejection, and the temperature of scores, from (language, length, cross-entropies) of texts held back.

    Texts of a language without a model tell nothing and are left out.
    """
    rows = [r for r in rows if r[0] in languages.names]
    right_ones = [(languages.names[int(np.argmin(e))], n, min(e)) for lang, n, e in rows if languages.names[int(np.argmin(e))] == lang]

    def limit(own: list[tuple[int, float]]) -> tuple[float, float]:
        n, e = np.array(own).T
        middle = float(np.median(e))
        return middle, float(1.4826 * np.median(np.abs(e - middle) * np.sqrt(n)))

    pooled = limit([(n, e) for _, n, e in right_ones]) if right_ones else (0.0, float("inf"))
    limits = []
    for name in languages.names:
        own = [(n, e) for lang, n, e in right_ones if lang == name]
        limits.append(limit(own) if len(own) >= 5 else pooled)  # too few to tell: those of all languages
    best, found = 1.0, -np.inf
    if rows:
        right = np.array([languages.names.index(lang) for lang, _, _ in rows])
        e, n = np.array([x[2] for x in rows]), np.array([x[1] for x in rows])
        for t in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            z = -e * np.sqrt(n)[:, None] / t
            z -= z.max(1, keepdims=True)
            fit_ = float((z[np.arange(len(z)), right] - np.log(np.exp(z).sum(1))).mean())
            best, found = (t, fit_) if fit_ > found else (best, found)
    return Languages(languages.names, languages.models, limits, best)


def _predict(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(languages) if languages.names else None
        limits = np.array(languages.limits).reshape(-1, 2)
        for batch in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if score is None:
                lang, sure, entropy, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
            else:
                e, n = score(texts)
                best = e.argmin(1)
                entropy = e[np.arange(len(e)), best]
                z = -(e - entropy[:, None]) * np.sqrt(np.maximum(n, 1))[:, None] / languages.temperature
                sure = np.where(n > 0, 1 / np.exp(z).sum(1), 0.0)
                lang = [languages.names[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                rejected = (n == 0) | (entropy > limits[best, 0] + MARGIN + SPREADS * limits[best, 1] / np.sqrt(np.maximum(n, 1)))
                entropy = np.where(n > 0, entropy, np.nan)
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*own, pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, languages: Languages, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `lang_pred`, `score` (0 to 1), `cross_entropy` (nats a character) and `rejected`.

    A text that is null or has no letter is `und`, score 0, null cross-entropy and rejected. Ties go to
    the language that comes first by name. Without any training text all are `und`. Letters beyond U+FFFE (rare historic
    scripts, mostly) are one symbol: languages are told from others by having them, not from one another.
    """
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInArrow(_predict(languages), ", ".join([*kinds, "lang_pred string", "score double", "cross_entropy double", "rejected boolean"]))


def accepted(docs: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text some model accepts."""
    plain = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] + [F.col(text_col).alias("__text")])
    kinds = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + ["lang_pred string", "score double", "cross_entropy double", "rejected boolean"])
    judged = plain.mapInArrow(_predict(languages), kinds).filter(~F.col("rejected"))
    return judged.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from models that never saw the held-out ones."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", F.coalesce(~may_train(), F.lit(False)).alias("held_out")), train(docs), keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op6_language_id": op6_language_id}
