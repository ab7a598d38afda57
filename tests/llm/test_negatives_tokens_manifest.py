"""Hard negatives, token files and the Merkle manifest against plain Python."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import hard_negatives, merkle, token_files
from textloom.llm.common import work_folder

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ---- hard negatives

def plain_negatives(rows):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label,
                     [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    anchors = {}
    for row in kept:
        if row[0] % 100 == 0:
            anchors[row[0]] = min(anchors.get(row[0], row), row, key=lambda r: (r[1], r[2]))
    out = []
    for anchor, label, q in anchors.values():
        scored = sorted(
            (-sum(a * b for a, b in zip(q, other)), i, of) for i, of, other in kept if i != anchor)
        for minus, positive, of in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            for rank, (score, negative, _) in enumerate(fits[:5], 1):
                out.append((anchor, positive, rank, negative, -minus, -score))
    return sorted(out)


@pytest.mark.parametrize("options", [
    {}, {"block": 3, "list_rows": 16, "cluster_size": 2}, {"block": 1, "most_clusters": 1}])
def test_hard_negatives_equal_all_pairs(spark, options):
    dice = random.Random(5)
    rows = []
    for i in range(0, 900, 3 if options else 1):
        centre = np.random.default_rng(i % 4).normal(size=6)
        vector = centre / 4 + np.random.default_rng(1000 + i % 150).normal(size=6) / 8
        rows.append((i, [float(x) for x in vector], dice.randrange(6)))
    rows += [(100, [0.5] * 6, 1), (200, None, 1), (300, [0.1] * 6, None), (None, [0.1] * 6, 2)]
    rows += [(9001, [None, 0.1], 1), (9002, [float("nan")] * 6, 1), (9003, [float("inf")] * 6, 1)]
    rows += [(9100, [0.3, 0.1], 2), (9200, [], 3), (9300, [0.2] * 9, 1), (9304, [0.2] * 9, 1)]
    rows += [(9105, [0.25] * 6, 2)] * 3 + [(9107, [-0.25] * 6, -4)]
    table = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("q", F.lit("clash"))
    got = hard_negatives.hard_negatives(hard_negatives.quantised(table), **options)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]


def test_hard_negatives_of_one_repeated_vector_and_of_nothing(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(600)]
    table = spark.createDataFrame(rows, VECTORS).repartition(7)
    got = hard_negatives.hard_negatives(hard_negatives.quantised(table), list_rows=32)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(hard_negatives.quantised(empty)).count() == 0
    with pytest.raises(Exception, match="whole-number form"):
        hard_negatives.hard_negatives(hard_negatives.quantised(
            spark.createDataFrame([(0, [1e30], 1)], VECTORS)))


# ---- token files

def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for count in (0, 1, 7, 4096, 65_535):
        for top in (1, 2, 257, 49_408, 2**32):
            values = rng.integers(0, top, count, dtype=np.uint64).astype(np.uint32)
            assert (token_files.unpack_block(token_files.pack_block(values)) == values).all()
    values = rng.integers(300, 800, 4096).astype(np.uint32)
    small = len(token_files.pack_block(values))
    values[[5, 77]] = 2**32 - 1
    patched = token_files.pack_block(values)
    assert len(patched) <= small + 12 and (token_files.unpack_block(patched) == values).all()


def test_shards_read_any_range():
    out, rng = io.BytesIO(), np.random.default_rng(2)
    writer = token_files.ShardWriter(out, block=16)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 3, 40, 1, 0, 100)]
    for i, ids in enumerate(docs):
        writer.add(i if i else None, ids)
    writer.close()
    reader, whole = token_files.ShardReader(out, out.tell()), np.concatenate(docs)
    for start in range(0, len(whole), 7):
        for stop in (start, start + 1, start + 30, len(whole) + 5):
            assert (reader.ids(start, stop) == whole[start:stop]).all()
    batch, = reader.batches(10)
    assert batch.column("doc_id").to_pylist() == [None, 1, 2, 3, 4, 5]
    assert batch.column("start").to_pylist() == [10, 10, 13, 53, 54, 54]
    assert [len(b) for b in batch.column("ids").to_pylist()] == [4 * len(d) for d in docs]


def test_word_encoder_equals_the_library():
    coder = token_files.WordEncoder(TOKENIZER, most=100)
    dice = random.Random(3)
    mixed = "abcAZ éÉßİıÀ'’.,!?0123²½ªº\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\x00\x7f\xad'S'llŉǅɏ中文éſK"
    texts = ["", " ", "I'll don't <|endoftext|> x", "<|endoftext", "x" * 5000, "Ж" * 300]
    texts += ["".join(dice.choice(mixed) for _ in range(dice.randrange(30))) for _ in range(3000)]
    texts += ["".join(chr(dice.randrange(0x250)) for _ in range(30)) for _ in range(1000)]
    for text in texts:
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == coder.library.encode(text, add_special_tokens=False).ids
    assert len(coder.chunks) <= 100


def test_token_files_in_document_order(spark):
    dice = random.Random(4)
    rows = [(dice.randrange(400), " ".join(
        dice.choice(("red", "Blue", "été", "naïve", "数据", "x1", "don't")) for _ in range(
            dice.randrange(60)))) for _ in range(500)]
    rows += [(None, "no id"), (None, None), (7, ""), (8, None), (401, "long word " * 30_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn(
        "ids", F.lit(1)).withColumn("start", F.lit("clash"))
    folder = work_folder(spark, "tokens")
    got = token_files.token_table(table, folder, TOKENIZER, shard_bytes=20_000, block=64).collect()
    library = Tokenizer.from_file(TOKENIZER)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start, stream = [], 0, []
    for doc_id, text in ordered:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start, stream = start + len(ids), [*stream, ids]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    whole = np.concatenate(stream)
    for low in (0, 1000, len(whole) - 5):
        assert (token_files.read_range(folder, low, low + 777) == whole[low:low + 777]).all()
    with pytest.raises(Exception, match="already holds"):
        token_files.token_table(table, folder, TOKENIZER)


def test_token_files_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    got = token_files.token_table(empty, work_folder(spark, "tokens"), TOKENIZER)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


# ---- Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join(
        "-" if v is None else f"{len(str(v).encode())}:{v}"
        for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Root, and per node the (left, right) siblings of every level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, places):
            run = at // 8 * 8
            path.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        places = [p // 8 for p in places]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        group = sorted(groups[name], key=lambda r: (
            r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[name] = (group, *plain_tree([plain_leaf(r) for r in group]))
    root, tops = plain_tree([trees[n][1] for n in names])
    out = []
    for name, top in zip(names, tops):
        group, subroot, paths = trees[name]
        for row, path in zip(group, paths):
            path = path + top
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf((row[0], text, *row[2:]))
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], plain_leaf(row), subroot, root, sha("".join(
                a + b for a, b in path)), folded, folded == root))
    return out


def test_manifest_equals_a_plain_tree(spark):
    dice = random.Random(6)
    sizes = {None: 3, "a": 1, "b": 8, "c": 9, "d": 64, "e": 513, "Ä": 700, "": 2, "zz": 4100}
    rows = []
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((dice.randrange(10**6), dice.choice(("Some TEXT", "é Ä", "", None, "plain")),
                         lang, dice.choice(("web", None)), dice.choice((5, None))))
    rows += [(None, "A", "b", None, 1), (None, None, None, None, None)] + [rows[50]] * 3
    rows += [(3, "x", f"many{i}", "s", i) for i in range(600)]
    table = spark.createDataFrame(rows, DOCS).repartition(6).withColumn("grp", F.lit(1)).withColumn(
        "path", F.lit("clash"))
    got = merkle.verified(table)
    key = str
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(
        plain_manifest(rows), key=key)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]


def test_manifest_of_one_row_and_of_none(spark):
    row = (3, "Text", "en", "web", 4)
    one = merkle.verified(spark.createDataFrame([row], DOCS)).collect()
    assert [tuple(r) for r in one] == plain_manifest([row])
    assert one[0].root == one[0].subroot == one[0].leaf
    assert merkle.verified(spark.createDataFrame([], DOCS)).count() == 0
