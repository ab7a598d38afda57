"""Content addresses: digests, name-based ids, plan hashes and translation keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID of a name in the URL namespace."""
    data = F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))
    digest = F.sha1(data)
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"),
        F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1,
        F.lit(1),
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def compact_id(col: Column) -> Column:
    """An id as (16 bytes, null) if it is a UUID, else as (null, text); equal just for equal ids."""
    uuid = F.regexp_like(col, F.lit(UUID)) & (F.length(col) == 36)  # $ allows a line break
    return F.struct(F.when(uuid, F.unhex(F.replace(col, F.lit("-")))).alias("uuid"),
                    F.when(~uuid, col).alias("text"))


def block_id(document_id: Column, seq: Column) -> Column:
    return uuid5_url(F.concat_ws(":", document_id, seq.cast("string")))


def plan_json(
    source_language: Column,
    domain: Column,
    register: Column,
    terms: Column,
    warnings: Column,
    triage_status: Column,
) -> Column:
    """Canonical JSON of a whole plan: keys sorted, list order kept."""
    return F.to_json(
        F.struct(
            domain.alias("domain"),
            register.alias("register"),
            source_language.alias("source_language"),
            terms.alias("terms"),
            triage_status.alias("triage_status"),
            warnings.alias("warnings"),
        ),
        {"ignoreNullFields": "false"},
    )


def plan_hash(**fields: Column) -> Column:
    return sha256(plan_json(**fields))


def glossary_json(glossary: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(glossary))))


def translation_key(
    target_language: Column,
    model: Column,
    prompt_version: Column,
    glossary: Column,
    plan_digest: Column,
) -> Column:
    """Identity of a translation set-up; the source text joins through its own hash."""
    parts = F.array(
        target_language, model, prompt_version, sha256(glossary_json(glossary)), plan_digest
    )
    return sha256(F.to_json(parts))


def identity_glossary(terms: Column) -> Column:
    distinct = F.array_distinct(terms)
    return F.map_from_arrays(distinct, distinct)


def request_digest(request_key: Column) -> Column:
    return sha256(request_key)


def batch_key(request_key: Column, languages: Column) -> Column:
    return F.concat_ws(
        ".", sha256(request_key), sha256(F.to_json(F.array_sort(languages)))
    )


def language_key(request_key: Column, language: Column) -> Column:
    return F.concat_ws(
        ".", sha256(request_key), sha256(F.concat(request_key, F.lit("\x00"), language))
    )
