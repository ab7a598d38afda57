"""The pipeline against its stages by brute force, and the contract of its stages."""

import base64
import hashlib
import inspect
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
import __spark_entry__ as contract
from textloom.llm import queries

WORDS = {
    "en": "the quick river stone under bright morning window never quiet garden shadow walks with "
          "which though every weather thing another brother north wish".split(),
    "es": "aquel camino rojo sobre la ventana nunca jardín sombra niño mañana corazón pequeño "
          "ciudad cuando lluvia pájaro según también árbol años llueve".split(),
}


def prose(dice, lang, n):
    return " ".join(dice.choice(WORDS[lang]) + str(dice.randrange(4)) * (dice.random() < 0.02)
                    for _ in range(n))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edits(item, text):
    """Fewest edits that turn the item into some substring of the text."""
    row = np.zeros(len(text) + 1, int)
    letters = np.array(list(text))
    for i, c in enumerate(item, 1):
        step = np.minimum(np.append(i, row[:-1] + (letters != c)), row + 1)
        row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
    return row.min()


def survivors(rows, items):
    """doc_ids after every stage, by plain Python; all planted languages are recognised."""
    stages = [{i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}]
    groups = {}
    for i, t in stages[0].items():
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    stages.append({i: stages[0][i] for _, i in map(min, groups.values())})
    sets = {i: shingles(t) for i, t in stages[1].items()}
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if low[a] < low[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    low[b] = low[a]
        if all(low[low[i]] == low[i] for i in low):
            break
    stages.append({i: t for i, t in stages[1].items() if low[i] == i})
    plain = [" ".join(t.lower().split()) for t in items]
    stages.append({i: t for i, t in stages[2].items() if not any(
        edits(item, " ".join(t.lower().split())) <= 0.08 * len(item) for item in plain)})
    return stages


def test_pipeline_against_brute_force(spark, tmp_path):
    dice = random.Random(11)
    rows = [(i, prose(dice, ("en", "es")[i % 2], 90), ("en", "es")[i % 2], "web", i)
            for i in range(60)]
    items = [prose(dice, "en", 30), prose(dice, "es", 25)]

    def changed(text, every):
        words = text.split()
        words[3::every] = ["changed"] * len(words[3::every])
        return " ".join(words)

    text = {r[0]: r[1] for r in rows}
    rows += [(100, text[1].replace(" ", "\n\t"), "es", "web", 1), (101, text[1] + "  ", None, "b", 1)]
    rows += [(102, changed(text[2], 80), "en", "web", 1), (103, changed(text[2], 40), "en", "x", 1)]
    rows += [(104, changed(text[4], 9), "en", "web", 1)]  # far from being a copy
    rows += [(110, f"{prose(dice, 'en', 40)} {items[0]} {prose(dice, 'en', 40)}", "en", "w", 1)]
    rows += [(111, f"{prose(dice, 'es', 40)} {changed(items[1], 26).upper()} fin", "es", "w", 1)]
    rows += [(112, f"{prose(dice, 'es', 40)} {items[1][:60]} {prose(dice, 'es', 9)}", "es", "w", 1)]
    rows += [(120, "12345 -- !!", "en", "w", 1), (121, None, "en", "w", 1), (122, "", None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                          "n_chars long").repartition(5).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{sf}/benchmark.parquet")

    expected = survivors(rows, items)
    assert {120, 121, 122}.isdisjoint(expected[0]) and {100, 101} & set(expected[1])
    assert not {102, 103} & set(expected[2]) and {104} < set(expected[2])
    assert not {110, 111} & set(expected[3]) and {112} < set(expected[3])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for (name, stage), ids in zip(corpus_pipeline.STAGES, expected, strict=False):
        docs = stage(spark, docs, sf)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(ids), name

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.round_trip) for r in out} == {
        i: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), True)
        for i, ids in ((i, coder.encode_ordinary(t)) for i, t in expected[3].items())}


def test_pipeline_keeps_what_every_stage_keeps(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) <= len(docs) and all(r.round_trip for r in out)
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out)
    seen = set()
    for i in sorted(kept):
        key = "".join(docs[i].split())
        assert key not in seen
        seen.add(key)
    items = [" ".join(r.text.lower().split()) for r in
             spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(item in " ".join(docs[i].lower().split()) for i in kept for item in items)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def test_one_query_per_operator():
    names = [n for n in contract.queries() if n.startswith("op")]
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY)
    assert numbers == list(range(1, 14)) and set(queries.REGISTRY) <= set(names)
    assert set(queries.ORACLE) < set(queries.REGISTRY) and "pipeline" in contract.queries()
