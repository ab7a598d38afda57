"""The given tables read as engine tables.

Every engine table is derived by Spark from whole given tables, so the work of each
query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from textloom.functions import identity
from textloom.operators import segmentation

MODEL_CASES = ("gpt-4o-mini", "gpt-4o", "gpt-6-luna", "gpt-5.6-luna", "unlisted-model")
LANGUAGE_CASES = ("de", "fr", "es", "uk")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than cores, dealt to all cores.

    A file of one row group is read by one task. Larger tables have files and row groups enough
    and stay where they lie, so that whole texts are never shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if len(df.inputFiles()) >= cores or not TINY < size <= cores * SMALL:
        return df
    return df.repartition(cores)


#: Bytes up to which a table is one task's work, and bytes per core up to which it is small.
TINY, SMALL = 1 << 20, 32 << 20


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """id, text, lang: the corpus as it is."""
    return spread(table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", "lang"
    ))


def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with Markdown put around its lines by line position."""
    lines = F.split("text", "\n", -1)

    def mark(line, i):
        turn = i % 10
        return (
            F.when(turn == 0, F.concat(F.repeat(F.lit("#"), 1 + (i / 10).cast("int") % 6),
                                       F.lit(" "), line))
            .when(turn == 2, F.concat(F.lit("- "), line))
            .when(turn == 3, F.concat(F.lit("  > "), line))
            .when(turn == 4, F.concat(F.lit("| "), line, F.lit(" |  | x\\|y | ")))
            .when(turn == 5, F.concat(F.lit("| --- | :---: |\n"), line))
            .when(turn == 6, F.concat(F.lit("12) "), line))
            .when(turn == 7, F.concat(F.lit("```sql\n"), line, F.lit("\n``\n````")))
            .when(turn == 8, F.concat(F.lit("   "), line, F.lit("  ")))
            .when(turn == 9, F.concat(line, F.lit("\r")))
            .otherwise(line)
        )

    return documents(spark, sf).withColumn(
        "text", F.array_join(F.transform(lines, mark), "\n")
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus lines as blocks."""
    return segmentation.segment_markdown(documents(spark, sf), fences=False)


def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return segmentation.segment_markdown(markdown_documents(spark, sf))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, turns as blocks; system turns stand for blank blocks."""
    return spread(table(spark, sf, "conversations")).select(
        F.col("conv_id").cast("string").alias("document_id"),
        F.col("turn").cast("int").alias("seq"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("source_text"),
    )


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as analysed documents."""
    k = F.col("doc_id")
    labels = table(spark, sf, "labels")
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    return labels.join(langs, "doc_id").select(
        k.cast("string").alias("document_id"),
        F.col("lang").alias("source_language"),
        F.lit("general").alias("domain"),
        F.when(F.col("toxic") == 1, "informal").otherwise("neutral").alias("register"),
        F.array(F.concat(F.lit("Term"), (k % 7).cast("string")), F.lit("Shared")).alias("terms"),
        F.when(F.col("quality") == 0, F.array(F.lit("heuristic")))
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
        F.when(F.col("quality") == 1, "ok").otherwise("degraded").alias("triage_status"),
        (100 + k % 50).alias("tokens_in"),
        (20 + k % 10).alias("tokens_out"),
        ((100 + k % 50) / 1e6).alias("cost_usd"),
        ((300 + k % 50) / 1e6).alias("cost_usd_total"),
        (300 + k % 50).alias("tokens_in_total"),
        (60 + k % 10).alias("tokens_out_total"),
    )


def pick(cases, index):
    return F.element_at(F.array(*[F.lit(c) for c in cases]), (index + 1).cast("int"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs: the customer is the document, the total price the cost."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.col("o_orderstatus")
    status = (
        F.when((state == "F") & (k % 5 == 0), "failed")
        .when((state == "F") & (k % 5 == 1), "completed_with_errors")
        .when(state == "F", "done")
        .when(state == "O", "queued")
        .when(k % 3 == 0, "assembling")
        .otherwise("running")
    )
    rows = table(spark, sf, "orders").select(
        k.cast("string").alias("id"),
        c.cast("string").alias("document_id"),
        F.concat_ws(".", (c % 50).cast("string"), (k % 3).cast("string")).alias("batch_id"),
        pick(LANGUAGE_CASES, k % 4).alias("target_language"),
        status.alias("status"),
        (3 + k % 5).cast("int").alias("total_chunks"),
        (k % 4).cast("int").alias("done_chunks"),
        (k % 11).alias("cache_hit_blocks"),
        (k % 6).alias("cache_miss_blocks"),
        pick(MODEL_CASES, k % 5).alias("model"),
        F.lit("v1").alias("prompt_version"),
        F.map_from_arrays(
            F.array(F.lit("Shared"), F.concat(F.lit("Term"), (c % 7).cast("string"))),
            F.array(F.lit("Shared"), F.concat(F.lit("Term"), (c % 7).cast("string"))),
        ).alias("glossary"),
        F.col("o_totalprice").alias("cost_usd"),
        F.concat_ws("-", F.lit("key"), (k % 9000).cast("string")).alias("idempotency_key"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_micros(
            F.unix_micros(F.col("o_orderdate")) + (k % 1000) * 1_500_500
        ).alias("updated_at"),
    )
    return rows.withColumn(
        "error_code",
        F.when(F.col("status") == "failed",
               pick(("provider_timeout", "render_failed", "never_catalogued"),
                    F.col("id").cast("bigint") % 3)),
    ).withColumn(
        "lease_expires_at",
        F.when(F.col("status").isin("running", "assembling") & (F.col("id").cast("bigint") % 7 > 0),
               F.timestamp_micros(F.unix_micros("created_at") + 3_600_000_000)),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct order lines as chunks."""
    base = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_shipdate").alias("created_at"), F.min("l_linestatus").alias("state"),
             F.min("l_suppkey").alias("supp"))
    )
    k = F.col("l_orderkey")
    status = (
        F.when(F.col("state") == "F", "done")
        .when(F.col("supp") % 2 == 0, "inflight")
        .otherwise("pending")
    )
    return base.select(
        F.concat_ws("-", k.cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        k.cast("string").alias("job_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("seq"),
        status.alias("status"),
        F.when((status == "inflight") & (F.col("supp") % 3 > 0), F.col("created_at"))
        .alias("lease_expires_at"),
        "created_at",
    )


def attempt_log(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as attempts, not yet numbered."""
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("chunk_id"),
        (F.col("l_quantity") * 10).cast("bigint").alias("tokens_in"),
        F.col("l_quantity").cast("bigint").alias("tokens_out"),
        (F.col("l_extendedprice") / 1e6).alias("cost_usd"),
        (F.col("l_partkey") * 7 % 20011).alias("latency_ms"),
        F.when(flag == "N", "ok").when(flag == "A", "retryable_error").otherwise("fatal_error")
        .alias("outcome"),
        F.col("l_shipdate").alias("created_at"),
        F.concat_ws(
            "/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
            F.col("l_quantity").cast("bigint").cast("string"),
            (F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("id"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators.costs import number_attempts

    return number_attempts(attempt_log(spark, sf))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as job observations; one job per user and day."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
        .alias("job_id"),
        "event_id",
        "ts",
        F.when(kind == "signup", "queued")
        .when(kind == "purchase", "done")
        .when(kind == "error", "failed")
        .otherwise("running")
        .alias("status"),
        F.col("value").alias("cost_usd"),
    )


def pages_as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as uploads with several suffixes and signatures."""
    k = F.col("page_id")
    suffix = pick((".md", ".pdf", ".docx", "", ".exe", ".MD"), k % 6)
    magic = (
        F.when(k % 6 == 1, F.when(k % 4 == 1, F.unhex(F.lit("255044462D"))))
        .when(k % 6 == 2, F.unhex(F.lit("504B0304")))
        .when((k % 6 == 3) & (k % 2 == 1), F.unhex(F.lit("255044462D")))
    )
    tail = F.when(k % 30 == 0, F.unhex(F.lit("FF"))).when(k % 42 == 5, F.unhex(F.lit("00")))
    empty = F.lit(b"")
    return table(spark, sf, "pages").select(
        F.concat(F.replace(F.element_at(F.split("url", "//"), -1), F.lit("."), F.lit("-")), F.lit("p"),
                 suffix).alias("filename"),
        F.concat(
            F.coalesce(magic, empty), F.encode("html", "UTF-8"), F.coalesce(tail, empty)
        ).alias("content"),
        k.alias("upload_no"),
    )


PLAN = {
    "domain": "general",
    "register": "neutral",
    "prompt_version": "v1",
}


def targets(names) -> Column:
    """(target, translation_key) of a document for every target language."""
    no_terms = F.array().cast("array<string>")
    digest = identity.plan_hash(
        source_language=F.col("lang"), domain=F.lit(PLAN["domain"]),
        register=F.lit(PLAN["register"]), terms=no_terms, warnings=no_terms,
        triage_status=F.lit("ok"),
    )
    return F.array(*[
        F.struct(
            F.lit(t).alias("target"),
            identity.translation_key(
                F.lit(t), F.lit("gpt-4o-mini"), F.lit(PLAN["prompt_version"]),
                F.map_from_arrays(no_terms, no_terms), digest,
            ).alias("translation_key"),
        )
        for t in names
    ])


def document_keys(spark: SparkSession, sf: str, names=("de", "uk")) -> DataFrame:
    """document_id, target, translation_key for every document and target language."""
    docs = documents(spark, sf).select(F.col("id").alias("document_id"), "lang")
    return docs.select("*", F.inline(targets(names)))


def keyed_blocks(spark: SparkSession, sf: str, names=("de", "uk")) -> DataFrame:
    """Blocks of every document and target with their translation key.

    Keys are made per document and travel with its blocks, so no join is needed.
    """
    docs = documents(spark, sf).withColumn("targets", targets(names))
    cut = segmentation.segment_markdown(docs, fences=False, keep=["lang", "targets"])
    return cut.select(
        "document_id", "lang", "seq", "id", "source_text", "source_hash", F.inline("targets")
    )


def memory(spark: SparkSession, sf: str) -> DataFrame:
    """Results stored earlier: the German side of every even document, first one kept."""
    return stored(keyed_blocks(spark, sf, ("de",)))


def stored(keyed: DataFrame) -> DataFrame:
    done = keyed.where(F.col("document_id").cast("bigint") % 2 == 0)
    return done.groupBy("translation_key", "source_hash").agg(
        F.min(F.concat(F.lit("[de] "), F.col("source_text"))).alias("translated_text")
    )
