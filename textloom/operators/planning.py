"""From documents and target languages to token-bounded work units and requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import identity, text
from textloom.functions.ordered import earliest, span, surrounding_values

BUCKET_ROWS = 4096


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Add normalized ``languages``; null when the request names none or a bad one."""
    return requests.withColumn("languages", text.normalize_languages(F.col("target_languages")))


def fan_out(docs: DataFrame, languages: Column) -> DataFrame:
    """One row per document and target language, with the language's request position."""
    return docs.select("*", F.posexplode(languages).alias("position", "target_language"))


def request_keys(requests: DataFrame) -> DataFrame:
    """Batch id and idempotency key for every (request_key, languages, target_language)."""
    key = F.btrim(F.col("request_key"), F.lit(text.WHITESPACE))
    return requests.select(
        "*",
        identity.batch_key(key, F.col("languages")).alias("batch_id"),
        identity.language_key(key, F.col("target_language")).alias("idempotency_key"),
    )


def idempotent_append(
    new: DataFrame, existing: DataFrame, order: list[Column], key: str = "idempotency_key"
) -> DataFrame:
    """New rows whose key is not stored yet; the first of a repeated key wins."""
    fresh = earliest(new, [key], order)
    return fresh.join(existing.select(key), key, "left_anti")


def key_conflicts(jobs: DataFrame) -> DataFrame:
    """Request digests used with more than one document or language set."""
    digest = F.substring_index("batch_id", ".", 1)
    spread = jobs.groupBy(digest.alias("request_digest")).agg(
        F.min("document_id").alias("_d0"), F.max("document_id").alias("_d1"),
        F.min("batch_id").alias("_b0"), F.max("batch_id").alias("_b1"),
        F.count(F.lit(1)).alias("jobs"),
    )
    return spread.where((F.col("_d0") != F.col("_d1")) | (F.col("_b0") != F.col("_b1"))).select(
        "request_digest", "jobs"
    )


def ready_documents(
    docs: DataFrame, analyses: DataFrame, glossaries: DataFrame | None = None
) -> DataFrame:
    """Readiness per document: extracted, analysed and with an up-to-date glossary.

    ``glossaries`` (document_id, glossary) holds snapshots taken earlier; a snapshot that no
    longer equals the identity glossary of the stored terms is stale.
    """
    known = analyses.select(F.col("document_id").alias("id"), "terms")
    joined = docs.join(known, "id", "left")
    pending = (F.col("status") != "extracted") | F.col("terms").isNull()
    if glossaries is None:
        verdict = F.when(pending, "analysis_pending").otherwise("ready")
        return joined.select("*", verdict.alias("readiness"))
    snapshots = glossaries.select(F.col("document_id").alias("id"), "glossary")
    current = identity.glossary_json(identity.identity_glossary(F.col("terms")))
    stale = current != identity.glossary_json(F.col("glossary"))
    verdict = (
        F.when(pending, "analysis_pending").when(stale, "glossary_changed").otherwise("ready")
    )
    return joined.join(snapshots, "id", "left").select("*", verdict.alias("readiness"))


def count_tokens(
    blocks: DataFrame, encode: Callable[[list[str]], list[int]] | None = None
) -> DataFrame:
    """Add ``tokens``. ``encode`` maps a batch of texts to counts; characters by default."""
    if encode is None:
        return blocks.withColumn("tokens", F.length("source_text").cast("bigint"))

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.tolist()))

    return blocks.withColumn("tokens", counted("source_text"))


# --- packing -------------------------------------------------------------------------
#
# Greedy packing decides every block from all earlier ones. A document is cut into spans of
# its block numbers; for each span of a long document we record how it would leave the open
# unit for every possible fill on entry, walk those small records in order, and then pack all
# spans independently. The result is the same as one pass over the document.


def _whole_runs(
    batches: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of complete runs of equal keys from a sorted stream, with the run borders.

    The last run of a batch waits for the next batch, which may continue it.
    """
    def borders(frame: pd.DataFrame) -> list[int]:
        change = np.zeros(len(frame), dtype=bool)
        for key in keys:
            values = frame[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return [0, *np.flatnonzero(change).tolist(), len(frame)]

    held = None
    for batch in batches:
        if batch.empty:
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cuts = borders(frame)
        held = frame.iloc[cuts[-2]:].reset_index(drop=True)
        if len(cuts) > 2:
            yield frame.iloc[:cuts[-2]], cuts[:-1]
    if held is not None:
        yield held, [0, len(held)]


def _unit_starts(upto: np.ndarray, first: int, budget: int) -> list[int]:
    """Positions where units start, the first one given. ``upto`` is the running sum."""
    starts = []
    while first < len(upto):
        starts.append(first)
        spent = upto[first - 1] if first else 0
        first = max(first + 1, int(np.searchsorted(upto, spent + budget, side="right")))
    return starts


def _profile(tokens: np.ndarray, budget: int) -> tuple:
    """How one span leaves the open unit, for every block the unit may end before."""
    upto = np.cumsum(tokens)
    count = len(upto)
    reach = min(count, int(np.searchsorted(upto, budget, side="right")) + 1)
    before = np.concatenate(([0], upto))
    follow = np.maximum(
        np.searchsorted(upto, before[:-1] + budget, side="right"), np.arange(count) + 1
    ).tolist()
    units, tail = [0] * (count + 1), [count] * (count + 1)
    for i in range(count - 1, -1, -1):
        after = follow[i]
        units[i] = 1 + units[after]
        tail[i] = tail[after] if after < count else i
    at = np.array(tail[:reach])
    return (
        upto[:reach].tolist(), units[:reach], (upto[-1] - before[at]).tolist(),
        (count - at).tolist(), int(upto[-1]), count,
    )


def _span_profiles(budget: int):
    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in _whole_runs(batches, ["document_id", "bucket"]):
            tokens = frame["tokens"].to_numpy()
            rows = [_profile(tokens[a:b], budget) for a, b in zip(cuts, cuts[1:], strict=False)]
            heads = frame[["document_id", "bucket"]].iloc[cuts[:-1]].reset_index(drop=True)
            columns = ["upto", "units", "tail_tokens", "tail_items", "total", "items"]
            yield heads.join(pd.DataFrame(rows, columns=columns))

    return profile


_PROFILE = (
    "document_id string, bucket bigint, upto array<bigint>, units array<bigint>, "
    "tail_tokens array<bigint>, tail_items array<bigint>, total bigint, items bigint"
)


def _entry_states(budget: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, unit, fill, items = None, -1, budget + 1, 0
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.document_id != document:
                    # The first span of a document enters with nothing open.
                    document, unit, fill, items = row.document_id, -1, budget + 1, 0
                else:
                    rows.append((document, row.bucket, unit, fill, items))
                at = int(np.searchsorted(row.upto, budget - fill, side="right"))
                if at < len(row.upto):
                    unit += int(row.units[at])
                    fill, items = int(row.tail_tokens[at]), int(row.tail_items[at])
                else:
                    fill, items = fill + int(row.total), items + int(row.items)
            if rows:
                yield pd.DataFrame(
                    rows, columns=["document_id", "bucket", "unit", "fill", "held"]
                )

    return walk


def _pack_spans(budget: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in _whole_runs(batches, ["document_id", "bucket"]):
            tokens = frame["tokens"].to_numpy()
            unit, fill, held = (frame[c].to_numpy() for c in ("unit", "fill", "held"))
            chunk = np.zeros(len(frame), dtype=np.int64)
            place = np.zeros(len(frame), dtype=np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                upto = np.cumsum(tokens[a:b])
                first = int(np.searchsorted(upto, budget - fill[a], side="right"))
                starts = _unit_starts(upto, first, budget)
                position = np.arange(b - a)
                behind = np.searchsorted(starts, position, side="right")
                chunk[a:b] = unit[a] + behind
                place[a:b] = position - np.array([-held[a], *starts])[behind]
            yield frame[[c for c in ("document_id", "seq", "id", "tokens") if c in frame]].assign(
                chunk_seq=chunk, seq_in_chunk=place
            )

    return pack


def pack_chunks(
    blocks: DataFrame, budget: int = schemas.CHUNK_TOKEN_BUDGET, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Greedy packing in block order: (document_id, seq, id, tokens, chunk_seq, seq_in_chunk).

    A block is never split; a unit closes when the next block would exceed the budget; an
    oversize block stands alone. Blocks without an id are packed without it.
    """
    name = ["id"] if "id" in blocks.columns else []
    spans = blocks.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.col("seq").cast("bigint").alias("seq"), *name,
        F.col("tokens").cast("bigint").alias("tokens"),
        span(F.col("seq"), bucket_rows).alias("bucket"),
    )
    keys = ["document_id", "bucket"]
    # Both passes read this one exchange, so the blocks are derived once.
    placed = spans.repartition(*keys)
    profiles = placed.sortWithinPartitions(*keys, "seq").mapInPandas(
        _span_profiles(budget), _PROFILE
    )
    # Spans after a document's first one; usually few, as most documents are one span.
    states = (
        profiles.repartition("document_id")
        .sortWithinPartitions(*keys)
        .mapInPandas(
            _entry_states(budget),
            "document_id string, bucket bigint, unit bigint, fill bigint, held bigint",
        )
    )
    # Partitioned again after the join: a skewed join may be split anywhere in a span.
    return (
        placed.join(states, keys, "left")
        .fillna({"unit": -1, "fill": budget + 1, "held": 0})
        .repartition(*keys)
        .sortWithinPartitions(*keys, "seq")
        .mapInPandas(
            _pack_spans(budget),
            "document_id string, seq bigint, " + "id string, " * len(name)
            + "tokens bigint, chunk_seq bigint, seq_in_chunk bigint",
        )
    )


def chunk_rows(packed: DataFrame) -> DataFrame:
    """One row per (document, chunk): block range, sizes."""
    return packed.groupBy("document_id", "chunk_seq").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("tokens"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )


def chunk_links(packed: DataFrame) -> DataFrame:
    """Chunk-to-block links in chunk order; the packing already counted positions."""
    return packed.select(
        "document_id", "chunk_seq", F.col("id").alias("block_id"), "seq_in_chunk"
    )


def neighbour_context(packed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nearest non-empty block before and after every chunk.

    Neighbours of each block come from spans of the document; a chunk takes the one before
    its first and the one after its last block. Of a block that is given twice, the later row
    counts, whose neighbour before is the block itself.
    """
    spoken = blocks.where(F.col("source_text") != "").select(
        "document_id", F.col("seq").cast("bigint").alias("seq"), "id")
    linked = surrounding_values(spoken, ["document_id"], [F.col("seq")], ["id", "seq"],
                                span(F.col("seq"), BUCKET_ROWS)).drop("id")
    ends = packed.select("document_id", "seq", "chunk_seq").join(linked, ["document_id", "seq"])
    first = F.struct("seq", -F.coalesce("before_seq", F.lit(-(2**62))))
    last = F.struct("seq", F.coalesce("after_seq", F.lit(2**62)))
    return ends.groupBy("document_id", "chunk_seq").agg(
        *[F.min_by(c, first).alias(c) for c in ("before_id", "before_seq")],
        *[F.max_by(c, last).alias(c) for c in ("after_id", "after_seq")],
    )


def _prompt_blocks(rows: Column) -> Column:
    return F.transform(
        F.array_sort(rows),
        lambda b: F.struct(
            b["seq"].alias("seq"), b["block_id"].alias("block_id"),
            b["source_text"].alias("source_text"),
        ),
    )


def build_requests(
    misses: DataFrame, context: DataFrame, blocks: DataFrame, plans: DataFrame,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One request per chunk with untranslated blocks.

    ``misses``: document_id, chunk_seq, target_language, seq, block_id, source_text. Without the
    last two it has source_hash, as text or bytes, and the blocks of that place and hash are asked
    for. ``context`` has one row per chunk; ``plans``: document_id, plan_json, glossary_json. A
    chunk is token-bounded, so its block list is too. Texts cross one exchange, by document, where
    both the blocks asked for and their neighbours are found. ``keep`` names columns of ``misses``
    that come back as ``kept``, one struct with block_id per block.
    """
    block = F.struct("seq", "block_id", "source_text")
    named = "source_text" in misses.columns
    found = block if named else F.col("source_hash")
    texts = blocks.select(
        "document_id", F.col("seq").cast("bigint").alias("seq"),
        F.col("id").alias("block_id"), "source_text",
    ).select("document_id", "seq", F.lit("text").alias("side"), block.alias("text"))
    asked = misses.select(
        "document_id", F.col("seq").cast("bigint").alias("seq"), F.lit("block").alias("side"),
        "chunk_seq", "target_language", found.alias("asked"),
        F.struct(F.lit(True).alias("_"), *keep).alias("kept"))
    near = context.where(F.col("chunk_seq").isNotNull()).select(
        "document_id", "chunk_seq", F.inline(F.array(*[
            F.struct(F.col(f"{side}_seq").cast("bigint").alias("seq"), F.lit(side).alias("side"))
            for side in ("before", "after")]))).where(F.col("seq").isNotNull())
    placed = texts.unionByName(asked, True).unionByName(near, True).where(
        F.col("document_id").isNotNull()).repartition("document_id")
    want = F.when(F.col("side") != "text", F.struct(
        "side", "chunk_seq", "target_language", "asked", "kept"))
    per_block = placed.groupBy("document_id", "seq").agg(
        F.collect_list("text").alias("texts"), F.collect_list(want).alias("wants"),
    ).select("document_id", "texts", F.explode("wants").alias("w")).select(
        "document_id", "texts", "w.*")
    # Repeated documents have a block twice: a neighbour counts as often, what is asked for once.
    own = F.col("asked")
    if not named:
        binary = misses.schema["source_hash"].dataType.typeName() == "binary"
        digest = (lambda t: F.unhex(identity.sha256(t))) if binary else identity.sha256
        same = F.filter("texts", lambda t: digest(t["source_text"]).eqNullSafe(F.col("asked")))
        own = F.try_element_at(F.when(F.size("texts") > 1, same).otherwise(F.col("texts")),
                               F.lit(1))
    sides = {s: F.when(F.col("side") == s, F.col("texts")) for s in ("before", "after")}
    per_chunk = per_block.groupBy("document_id", "chunk_seq").agg(
        F.collect_list(F.when((F.col("side") == "block") & own.isNotNull(), F.struct(
            "target_language", own.alias("block"), "kept"))).alias("own"),
        *[F.flatten(F.collect_list(c)).alias(s) for s, c in sides.items()],
    ).where(F.size("own") > 0)

    def each(side: str) -> Column:
        """Lists of one neighbour, an empty one if there is none."""
        single = F.transform(side, lambda t: F.array(t))
        return F.explode(F.when(F.size(side) > 0, single).otherwise(
            F.array(F.slice(side, 1, 0)))).alias(side)

    languages = F.array_distinct(F.col("own")["target_language"])
    for_target = per_chunk.select(
        "document_id", "chunk_seq", "own", "after", each("before"),
    ).select("document_id", "chunk_seq", "own", "before", each("after")).select(
        "document_id", "chunk_seq", "own", "before", "after",
        F.explode(languages).alias("target_language"),
    ).withColumn("own", F.filter(
        "own", lambda o: o["target_language"].eqNullSafe(F.col("target_language"))))
    payload = F.to_json(F.struct(
        F.col("before").alias("context_before"),
        _prompt_blocks(F.col("own")["block"]).alias("blocks_to_translate"),
        F.col("after").alias("context_after"),
    ))
    kept = F.transform("own", lambda o: F.struct(
        o["block"]["block_id"].alias("block_id"), *[o["kept"][c].alias(c) for c in keep]))
    return for_target.join(plans, "document_id").select(
        "document_id", "chunk_seq", "target_language", "plan_json", "glossary_json",
        payload.alias("payload_json"), F.size("own").cast("bigint").alias("block_count"),
        *([kept.alias("kept")] if keep else []),
    )


def chunk_blocks_of(
    jobs: DataFrame, chunks: DataFrame, links: DataFrame, blocks: DataFrame
) -> DataFrame:
    """Blocks of every chunk with their position; order by seq_in_chunk to list one."""
    owned = chunks.select(F.col("id").alias("chunk_id"), "job_id").join(
        jobs.select(F.col("id").alias("job_id"), "document_id"), "job_id"
    )
    texts = blocks.select(F.col("id").alias("block_id"), "document_id", "source_text", "seq")
    return links.join(owned, "chunk_id").join(texts, ["block_id", "document_id"])
