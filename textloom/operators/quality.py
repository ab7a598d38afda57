"""Text-pair quality: character n-gram F-score and literal preservation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import schemas
from textloom.functions import text

# The literal syntax, written with explicit Unicode classes.
_W = text.WORD_CLASS
_S = text.SPACE_CLASS
_D = r"\p{Nd}"
CURRENCY_CODES = "USD|EUR|GBP|JPY|CHF|CAD|AUD|NZD|CNY|INR|UAH|PLN|SEK|NOK|DKK"
PLACEHOLDER = r"\{\{[^{}]*+\}\}|%s|\[[^\[\]]*+\]"
DATE = (
    rf"(?<!{_W})(?:{_D}{{4}}[./-]{_D}{{1,2}}[./-]{_D}{{1,2}}"
    rf"|{_D}{{1,2}}[./-]{_D}{{1,2}}[./-]{_D}{{2,4}})(?!{_W})"
)
_MONEY = rf"(?:[$€£¥]|{CURRENCY_CODES})"
CURRENCY = (
    rf"(?<!{_W})(?:{_MONEY}{_S}*[-+]?{_D}[\p{{Nd}}.,]*|[-+]?{_D}[\p{{Nd}}.,]*{_S}*{_MONEY})(?!{_W})"
)
_DIGITS = rf"[-+]?{_D}++(?:[.,]{_D}++(?!{_W}))*+"
NUMBER = rf"(?<!{_W}){_DIGITS}(?:{_S}?%)(?!{_W})|(?<!{_W}){_DIGITS}(?!{_W})"
# The look-ahead passes over the characters with which no literal begins.
LITERAL = (
    rf"(?iu)(?=[\[{{%$€£¥+\-\p{{Nd}}]|{CURRENCY_CODES})"
    rf"(?:{PLACEHOLDER}|{DATE}|{CURRENCY}|{NUMBER})"
)


def without_spaces(col: Column) -> Column:
    return F.regexp_replace(col, text.SPACE_CLASS + "+", "")


def char_ngrams(df: DataFrame, column: str, max_order: int = 6) -> DataFrame:
    """One row per character n-gram of orders 1 to ``max_order``, spaces removed."""
    # Characters are cut apart once; a gram joins its own few, so the work is linear in the text.
    chars = df.withColumn("_c", F.split(without_spaces(F.col(column)), ""))
    order = F.explode(F.sequence(F.lit(1), F.lit(max_order))).alias("order")
    grams = F.transform(
        F.sequence(F.lit(1), F.size("_c") - F.col("order") + 1),
        lambda i: F.array_join(F.slice("_c", i, F.col("order")), ""),
    )
    return (
        chars.where(F.size("_c") > 0).select("*", order)
        .where((F.size("_c") >= F.col("order")) & (F.element_at("_c", 1) != ""))
        .select("*", F.explode(grams).alias("gram"))
        .drop("_c")
    )


def _gram_counts(
    candidates: Sequence[str], references: Sequence[str], max_order: int
) -> np.ndarray:
    """Grams matched, of the candidate and of the reference: (3, order, pair).

    All pairs are counted together: a gram is numbered by (gram one shorter, next character),
    so one sort per order counts every gram of every pair.
    """
    count = len(candidates)
    texts = [*candidates, *references]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = codes.astype(np.int64)
    owner = np.repeat(np.arange(2 * count), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    gram = owner % max(count, 1)
    start = np.arange(len(codes))
    counts = np.zeros((3, max_order, count))
    for order in range(1, max_order + 1):
        fits = left[start] >= order
        start, gram = start[fits], gram[fits]
        if not len(start):
            break
        _, first, gram = np.unique(
            gram * 0x110000 + codes[start + order - 1], return_index=True, return_inverse=True
        )
        side = owner[start] // count
        mine = np.bincount(gram[side == 0], minlength=len(first))
        theirs = np.bincount(gram[side == 1], minlength=len(first))
        pair = owner[start[first]] % count
        for i, grams in enumerate((np.minimum(mine, theirs), mine, theirs)):
            counts[i, order - 1] = np.bincount(pair, grams, minlength=count)
    return counts


def _match_rates(
    candidates: Sequence[str], references: Sequence[str], max_order: int
) -> tuple[np.ndarray, np.ndarray]:
    """Mean precision and recall over the orders both sides reach, per pair."""
    matched, have, want = _gram_counts(candidates, references, max_order)
    both = (have > 0) & (want > 0)
    known = np.maximum(both.sum(0), 1)
    return (np.divide(matched, have, out=np.zeros_like(have), where=both).sum(0) / known,
            np.divide(matched, want, out=np.zeros_like(want), where=both).sum(0) / known)


_SLICE_CHARS = 1_000_000


def chrf(pairs: DataFrame, beta: float = 2, max_order: int = 6) -> DataFrame:
    """Score of every (pair_id, candidate, reference) on a scale of 0 to 100.

    A pair is one row, so it is scored where it lies. Spreading its grams as rows would
    shuffle about twelve rows per character. Orders for which either side is too short do
    not count.
    """
    if beta <= 0 or max_order <= 0:
        raise ValueError(f"beta {beta} and order {max_order} must be above zero")
    weight = float(beta) ** 2

    @F.pandas_udf(T.DoubleType())
    def score(candidates: pd.Series, references: pd.Series) -> pd.Series:
        # Whole pairs, in slices that bound the memory of the sorts.
        chars = (candidates.str.len() + references.str.len()).cumsum()
        scores = []
        for _, rows in candidates.groupby(chars // _SLICE_CHARS, sort=False):
            p, q = _match_rates(rows.tolist(), references[rows.index].tolist(), max_order)
            bottom = weight * p + q
            scores.append(pd.Series(
                np.where(bottom > 0, 100.0 * (1 + weight) * p * q / np.where(bottom, bottom, 1), 0),
                index=rows.index,
            ))
        return pd.concat(scores) if scores else pd.Series([], dtype="float64")

    def side(name: str) -> Column:
        return F.coalesce(without_spaces(F.col(name)), F.lit(""))

    return pairs.select("pair_id", score(side("candidate"), side("reference")).alias("chrf"))


# --- scores of whole corpora ----------------------------------------------------------

#: Chances of 0, 1, 2, .. draws of a pair in a resample: the Poisson distribution with mean 1.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
#: Weights of up to that many pairs are held at once.
_WEIGHED = 4096


def resample_weights(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """How often each pair is drawn in each resample: (pair, resample).

    Drawn from the pair's hash, so a pair weighs the same for every model and in every task.
    """
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + (
        np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    uniform = ((x ^ x >> np.uint64(31)) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_DRAWS, uniform, side="right")


def _corpus_counts(max_order: int, resamples: int):
    """Per group and resample (0 is the corpus itself) the summed gram counts of a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, len(batch), _WEIGHED):
                part = batch.iloc[start:start + _WEIGHED]
                counts = _gram_counts(
                    part["candidate"].tolist(), part["reference"].tolist(), max_order)
                counts = counts.reshape(3 * max_order, -1)
                weights = np.ones((len(part), 1 + resamples))
                weights[:, 1:] = resample_weights(part["hash"].to_numpy(), resamples)
                for group, rows in part.reset_index(drop=True).groupby("model").groups.items():
                    at = rows.to_numpy()
                    sums[group] = sums.get(group, 0) + weights[at].T @ counts[:, at].T
        for group, table in sums.items():
            yield pd.DataFrame({
                "model": group, "resample": np.arange(1 + resamples), "counts": list(table)})
    return run


def corpus_chrf(
    pairs: DataFrame, beta: float = 2, max_order: int = 6, resamples: int = 0
) -> DataFrame:
    """Score of a model's whole output: (model, resample, chrf); resample 0 is the output itself.

    ``pairs`` has model, pair_id, candidate and reference. Gram counts of all pairs are summed
    before precision and recall are taken, so long pairs weigh more. Further resamples draw every
    pair a Poisson number of times, the same one for all models. All of it takes one pass; a task
    hands on one row per model and resample. Null texts count as empty; rows without a model are
    left out.
    """
    side = {n: F.coalesce(without_spaces(F.col(n)), F.lit("")).alias(n)
            for n in ("candidate", "reference")}
    summed = pairs.where(F.col("model").isNotNull()).select(
        F.col("model").cast("string").alias("model"), F.xxhash64("pair_id").alias("hash"),
        *side.values(),
    ).mapInPandas(
        _corpus_counts(max_order, resamples), "model string, resample int, counts array<double>")
    numbered = summed.select("model", "resample", F.posexplode("counts").alias("at", "n")).groupBy(
        "model", "resample", "at").agg(F.sum("n").alias("n"))
    orders = numbered.groupBy(
        "model", "resample", F.pmod("at", F.lit(max_order)).alias("order")).agg(*[
            F.sum(F.when(F.floor(F.col("at") / max_order) == i, F.col("n"))).alias(name)
            for i, name in enumerate(("matched", "have", "want"))])
    both = (F.col("have") > 0) & (F.col("want") > 0)
    rates = orders.groupBy("model", "resample").agg(
        F.avg(F.when(both, F.col("matched") / F.col("have"))).alias("p"),
        F.avg(F.when(both, F.col("matched") / F.col("want"))).alias("q"))
    weight = float(beta) ** 2
    bottom = weight * F.col("p") + F.col("q")
    return rates.select("model", "resample", F.coalesce(F.when(
        bottom > 0, 100.0 * (1 + weight) * F.col("p") * F.col("q") / bottom), F.lit(0.0),
    ).alias("chrf"))


def chrf_difference(
    pairs: DataFrame, model: str, other: str, resamples: int = 200, level: float = 0.95, **options
) -> DataFrame:
    """How much better ``model`` scores than ``other``: (difference, low, high, better_share).

    ``low`` and ``high`` hold ``level`` of the differences of paired resamples between them, by
    nearest rank; ``better_share`` is the share of resamples in which ``model`` is ahead.
    """
    scores = corpus_chrf(
        pairs.where(F.col("model").isin(model, other)), resamples=resamples, **options)
    paired = scores.groupBy("resample").agg(
        *[F.max(F.when(F.col("model") == m, F.col("chrf"))).alias(n)
          for m, n in ((model, "a"), (other, "b"))]
    ).select("resample", (F.col("a") - F.col("b")).alias("d"))
    tail = (1 - level) / 2
    drawn = F.array_sort(F.collect_list(F.when(F.col("resample") > 0, F.col("d"))))  # resamples
    low, high = max(1, math.ceil(tail * resamples)), math.ceil((1 - tail) * resamples)
    return paired.agg(
        F.max(F.when(F.col("resample") == 0, F.col("d"))).alias("difference"),
        F.get(drawn, F.lit(low - 1)).alias("low"), F.get(drawn, F.lit(high - 1)).alias("high"),
        F.avg(F.when(F.col("resample") > 0, (F.col("d") > 0).cast("double"))).alias(
            "better_share"))


def literal_category(token: Column) -> Column:
    """Category of a matched literal, in priority order."""
    def whole(pattern: str) -> Column:
        return F.regexp_like(token, F.lit(rf"(?iu)^(?:{pattern})\z"))

    return (
        F.when(whole(PLACEHOLDER), "placeholder").when(whole(DATE), "date")
        .when(whole(CURRENCY), "currency").otherwise("number")
    )


def extract_literals(df: DataFrame, column: str) -> DataFrame:
    """One row per literal with its position and category, left to right."""
    found = F.posexplode(F.regexp_extract_all(F.col(column), F.lit(LITERAL), F.lit(0)))
    return df.select("*", found.alias("position", "token")).withColumn(
        "category", literal_category(F.col("token"))
    )


def preservation(pairs: DataFrame) -> DataFrame:
    """Preserved share of literals per pair and category, plus an ``overall`` row.

    ``pairs``: pair_id, source, translated. Repeats count separately; percent is null when
    the source has none.
    """
    sides = pairs.select(
        "pair_id",
        F.inline(F.array(
            F.struct(F.lit(1).alias("s"), F.col("source").alias("t")),
            F.struct(F.lit(0).alias("s"), F.col("translated").alias("t")),
        )),
    )
    tokens = extract_literals(sides, "t").groupBy("pair_id", "category", "token").agg(
        F.sum("s").alias("s"), F.sum(1 - F.col("s")).alias("t")
    )
    per_pair = tokens.groupBy("pair_id").agg(*[
        F.sum(F.when(F.col("category") == c, value)).alias(f"{c}_{part}")
        for c in schemas.LITERAL_CATEGORIES
        for part, value in (("n", F.col("s")), ("k", F.least("s", "t")))
    ])
    names = schemas.LITERAL_CATEGORIES

    def entry(name: str, n: Column, k: Column) -> Column:
        return F.struct(
            F.lit(name).alias("category"), n.alias("source_count"), k.alias("preserved_count"),
            F.when(n > 0, 100.0 * k / n).alias("preservation_percent"),
        )

    def count(name: str, part: str) -> Column:
        return F.coalesce(F.col(f"{name}_{part}"), F.lit(0))

    rows = [entry(c, count(c, "n"), count(c, "k")) for c in names]
    rows.append(entry(
        "overall", sum((count(c, "n") for c in names), F.lit(0)),
        sum((count(c, "k") for c in names), F.lit(0)),
    ))
    return pairs.select("pair_id").join(per_pair, "pair_id", "left").select(
        "pair_id", F.inline(F.array(*rows))
    )


def quality_report(texts: DataFrame) -> DataFrame:
    """Score and overall preservation per document.

    ``texts``: pair_id, source, translated, reference, round_trip. With a reference the
    translation is scored against it, otherwise the round trip against the source.
    """
    by_reference = F.col("reference").isNotNull()
    pairs = texts.select(
        "pair_id",
        F.when(by_reference, F.col("translated")).otherwise(F.col("round_trip")).alias("candidate"),
        F.when(by_reference, F.col("reference")).otherwise(F.col("source")).alias("reference"),
    )
    kept = preservation(texts.select("pair_id", "source", "translated")).where(
        F.col("category") == "overall"
    ).drop("category")
    modes = texts.select(
        "pair_id", F.when(by_reference, "reference").otherwise("back_translation").alias("mode")
    )
    return modes.join(chrf(pairs), "pair_id").join(kept, "pair_id")
