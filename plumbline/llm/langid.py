"""Language identification by error-correcting output codes.

Each language has a codeword. One binary classifier per bit, linear over hashed byte n-grams, predicts
whether a text's language has that bit set. Decoding adds up each codeword's losses over all bits and
takes the nearest codeword; a runner-up about as near marks the result as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches, quoted, unused

#: Buckets of hashed n-grams of 1, 2 and 3 bytes.
BUCKETS = 1 << 13
#: Labelled rows per language that training takes about.
SAMPLE_ROWS = 400
#: Bits of a codeword.
BITS = 15
STEPS, RATE, DECAY = 300, 4.0, 1e-5
#: A runner-up whose loss lies within this share of a bit is as near as the winner.
AMBIGUOUS = 0.05
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """The text's hashed byte n-grams of three orders, scaled to unit length by order."""
    # Digits and punctuation say little about a language: runs of them count as one blank.
    plain = re.sub(r"[\W\d_]+", " ", text).lower()
    b = np.frombuffer(f" {plain} ".encode(errors="replace"), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.float32)
    grams = [b, b[:-1] * np.uint32(0x9E3B) + b[1:] * np.uint32(0x3D4D) + np.uint32(7)]
    grams.append((b[:-2] * np.uint32(0x85EBCA6B)) ^ (b[1:-1] * np.uint32(0xC2B2AE35)) ^ (b[2:] * np.uint32(0x27D4EB2F)))
    for g in grams:
        mixed = ((g * np.uint32(2654435769)) >> np.uint32(19)) & np.uint32(BUCKETS - 1)
        own = np.sqrt(np.bincount(mixed, minlength=BUCKETS))
        out += own / max(1e-9, float(np.sqrt((own**2).sum())))
    return out


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of +1 and -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; texts without a letter are of no language."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        for at in range(0, len(known), 128):
            part = known[at : at + 128]
            margins = np.stack([counts(texts[i]) for i in part]) @ self.weights + self.bias
            # Each bit's logistic loss against each codeword: confident bits weigh more.
            losses = np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :]).sum(axis=2)
            shares = np.exp(losses.min(axis=1, keepdims=True) - losses)
            shares /= shares.sum(axis=1, keepdims=True)
            for i, loss, share in zip(part, losses, shares, strict=True):
                best = int(loss.argmin())
                rest = np.delete(loss, best)
                out[i] = (self.languages[best], float(share[best]), bool(len(rest) and rest.min() - loss[best] < AMBIGUOUS))
        return out


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """Codewords far from each other: the best of many random tables; every bit divides the languages."""
    if n < 2:
        return np.ones((n, bits), np.float32)
    source, best, far = np.random.default_rng(7), None, -1
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    for _ in range(64 if n > 32 else 400):
        table = source.integers(0, 2, (n, bits)) * 2 - 1
        same = np.abs(table.sum(axis=0)) == n
        table[0, same] *= -1
        apart = ((bits - table @ table.T) // 2 + np.eye(n, dtype=int) * bits).min()
        if apart > far:
            best, far = table, apart
    return best.astype(np.float32)


def fit(texts: list[str], labels: list[str]) -> Model:
    """Fits the bit classifiers by gradient descent on the logistic loss, languages weighted alike."""
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    if not texts:
        return Model([], codes, np.zeros((BUCKETS, BITS), np.float32), np.zeros(BITS, np.float32))
    x = np.stack([counts(t) for t in texts])
    which = np.array([languages.index(v) for v in labels])
    y = codes[which]
    share = (1 / np.bincount(which)[which] / len(languages)).astype(np.float32)[:, None]
    w, bias = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    for _ in range(STEPS):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30))) * share
        w -= RATE * (x.T @ slope + DECAY * w)
        bias -= RATE * slope.sum(axis=0)
    return Model(languages, codes, w, bias)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on rows with a text and a language that are not held out, about ``rows`` of each language.

    The sample is taken by a hash of ``doc_id``; it has at most 4 * ``rows`` times the number of languages.
    Without labelled rows the model knows no language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], [])
    chance = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(chance)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("language sample")), F.lit(1 << 20))
    # Rows of one id share a place; should that draw more than the bound, the first by place stay.
    drawn = usable.where(place / (1 << 20) < chance).orderBy(place, "lang", F.xxhash64("text")).limit(4 * rows * len(sizes))
    sample = sorted((r["doc_id"] or 0, r["lang"], r["text"]) for r in drawn.select("doc_id", "lang", "text").collect())
    return fit([t for _, _, t in sample], [v for _, v, _ in sample])


def identify(docs: DataFrame, model: Model, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` and ``lang_pred, score, ambiguous`` (with ``prefix``, and underscores before it where ``keep`` has that name) of every row, by its whole ``text``.

    Null texts and texts without a letter are of no language (``und``, score 0, ambiguous). Rows are judged
    one by one, so repeated rows get the same result; an empty table gives no rows. Of languages whose codewords come equally
    near, the first by name is predicted, and the text is ambiguous.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [*keep, *(unused(keep, prefix + c) for c in ("lang_pred", "score", "ambiguous"))]
    # Columns go through Python by number, whatever their names hold.
    chosen = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(quoted(keep))), F.col("text").cast("string").alias("said"))
    kinds = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]

    def run(batches):
        for batch in batches:
            found = list(zip(*shared.value.predict(batch.column("said").to_pylist()), strict=True)) or [[]] * 3
            values = [pa.array(list(c), t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *values], names=[*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], *kinds])).toDF(*names)
