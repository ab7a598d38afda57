"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting is one pass: every task counts n-gram buckets per language in one dense matrix, emits its
non-zero cells, and Spark adds them up. The model is the matrix of smoothed log probabilities, as
large as languages x buckets whatever the corpus holds; it is broadcast. Scoring treats a batch as
a sparse matrix (rows are texts, columns are buckets, in compressed-row form) and multiplies it with
the model in numpy, a bounded piece of text at a time.

Texts are lower-cased; everything that is no letter counts as a space, and grams without a letter
count for nothing. A text that is null or has no letter is `und` with score 0; so is every text
when nothing labelled was seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bounded_batches, in_pieces, strings

UNKNOWN = "und"
_PIECE = 1 << 18  # code points handled at once


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # sorted, so that ties go to the first
    weights: np.ndarray  # float64 [languages, buckets], log probabilities
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all code points."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str, overlap: int) -> Iterator[tuple[int, str]]:
    """Pieces of a text; the number says how many leading code points were seen before."""
    yield 0, text[:_PIECE]
    for start in range(_PIECE, len(text), _PIECE):
        yield overlap, text[start - overlap:start + _PIECE]


def _batches_of_pieces(texts: list[str], overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, code points seen before, piece) of bounded size together."""
    waiting, size = [], 0
    for row, text in enumerate(texts):
        for seen, piece in _pieces(text.lower(), overlap):
            if size and size + len(piece) > _PIECE:
                yield waiting
                waiting, size = [], 0
            waiting.append((row, seen, piece))
            size += len(piece)
    if waiting:
        yield waiting


def _buckets(
    pieces: list[tuple[int, int, str]], orders: tuple[int, ...], bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``pieces``, bucket) of every gram, piece by piece within each order."""
    lengths = np.array([len(p) for _, _, p in pieces], np.int64)
    points = np.frombuffer("".join(p for _, _, p in pieces).encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    codes = np.where(letter, points, 32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # code points to the piece's end
    into = np.repeat(lengths, lengths) - left
    seen = np.repeat(np.array([s for _, s, _ in pieces], np.int64), lengths)
    owners, found = [], []
    hashed, any_letter = np.zeros(len(points), np.uint64), np.zeros(len(points), bool)
    for order in range(1, max(orders) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        # A gram's hash follows from that of its beginning.
        hashed = (hashed[:n] + codes[order - 1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(31)
        any_letter = any_letter[:n] | letter[order - 1:]
        if order not in orders:
            continue
        # Inside its piece, not wholly seen in the piece before, and with a letter.
        keep = any_letter & (left[:n] >= order) & (into[:n] + order > seen[:n])
        mixed = hashed[keep] * np.uint64(0xD6E8FEB86659FD93)
        found.append((mixed >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(owner[:n][keep])
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(owners), np.concatenate(found)


def _count(orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in in_pieces(batches):
            labels = batch.column("label").to_pylist()
            texts = strings(batch.column("text"))
            for label in labels:
                counts.setdefault(label, np.zeros(1 << bits, np.int64))
                docs[label] = docs.get(label, 0) + 1
            for pieces in _batches_of_pieces(texts, max(orders) - 1):
                owners, buckets = _buckets(pieces, orders, bits)
                rows = np.array([counts_at for counts_at, _, _ in pieces], np.int64)[owners]
                for label in {labels[r] for r, _, _ in pieces}:
                    of_label = np.array([x == label for x in labels], bool)
                    counts[label] += np.bincount(
                        buckets[of_label[rows]], minlength=1 << bits)
        for label, cells in counts.items():
            at = np.flatnonzero(cells)
            yield pa.record_batch([
                pa.array([label] * (len(at) + 1), pa.string()),
                pa.array(np.concatenate([[-1], at]), pa.int64()),  # -1: number of texts
                pa.array(np.concatenate([[docs[label]], cells[at]]), pa.int64()),
            ], names=["label", "bucket", "n"])
    return run


def fit(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang",
    orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.5,
) -> Model:
    """A model from all rows with a label.

    What reaches the driver is one row per language and bucket in use: at most
    languages x 2**bits, however large the corpus.
    """
    bounded_batches(docs.sparkSession)
    cells = (
        docs.select(
            F.col(f"`{text_col}`").cast("string").alias("text"),
            F.col(f"`{label_col}`").cast("string").alias("label"),
        )
        .where("label is not null")
        .mapInArrow(_count(orders, bits), "label string, bucket long, n long")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = tuple(sorted(cells["label"].unique()))
    counts = np.zeros((len(languages), 1 << bits))
    texts = np.zeros(len(languages))
    for i, language in enumerate(languages):
        own = cells[cells["label"] == language]
        grams = own[own["bucket"] >= 0]
        counts[i, grams["bucket"].to_numpy()] = grams["n"].to_numpy()
        texts[i] = own.loc[own["bucket"] < 0, "n"].sum()
    smooth = counts + smoothing
    weights = np.log(smooth / smooth.sum(1, keepdims=True)) if len(languages) else smooth
    prior = np.log(texts / texts.sum()) if len(languages) else texts
    return Model(languages, weights, prior, orders, bits)


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """(language, posterior probability) of each text."""
    if not model.languages or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    totals = np.tile(model.prior, (len(texts), 1))
    grams = np.zeros(len(texts), np.int64)
    for pieces in _batches_of_pieces(texts, max(model.orders) - 1):
        owners, buckets = _buckets(pieces, model.orders, model.bits)
        if not len(owners):
            continue
        # Each order comes piece by piece, so the runs of `owners` are the rows of a sparse
        # matrix in compressed form, and the product is one gather and one sum per language.
        starts = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1])
        rows = np.array([r for r, _, _ in pieces], np.int64)[owners[starts]]
        for i in range(len(model.languages)):
            np.add.at(totals[:, i], rows, np.add.reduceat(model.weights[i][buckets], starts))
        np.add.at(grams, rows, np.diff(np.append(starts, len(owners))))
    shifted = np.exp(totals - totals.max(1, keepdims=True))
    best = totals.argmax(1)
    share = shifted.max(1) / shifted.sum(1)
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best, grams, strict=True)]
    return names, np.where(grams > 0, share, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in front, the row itself packed in ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            texts = strings(batch.column("row").field(text_col).cast(pa.string()))
            names, scores = score_texts(texts, shared.value)
            yield pa.record_batch(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 batch.column("row")], names=["lang_pred", "score", "row"])

    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        packed.schema["row"],
    ])
    return packed.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the labelled rows that are not held out."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), is_held_out(F.col("row.doc_id")).alias("held_out"),
        "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows with a language: not `und`, and more likely than ``least`` to be the one named.

    Where nothing is labelled there is no model, and every row stays.
    """
    model = fit(docs.where(~is_held_out(F.col("doc_id"))).select("text", "lang"))
    if not model.languages:
        return docs
    kept = predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select("row.*")
