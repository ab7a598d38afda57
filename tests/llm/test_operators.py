"""The training-text operators against brute force, and at the edges of their input."""

import hashlib
import math
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from textloom.llm import (
    byte_bpe,
    chunk_dedup,
    components,
    decontamination,
    exact_dedup,
    html_templates,
    language_id,
    license_rules,
    simhash_golay,
    suffix_dedup,
    suffix_sort,
    url_templates,
)
from textloom.llm.oracle import url_template_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string"


def documents(spark, rows):
    """A table like `documents` with two more columns whose names the operators use themselves."""
    full = [(i, t, *rest, None, "x")[:4] + (len(t or ""), 7, "d") for i, t, *rest in (
        (*r, None, None) for r in rows)]
    return spark.createDataFrame(full, DOCS)


WORDS = "the of and thing ering tion blest anor heou sten wh at on".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "é ß 日本 😀"), (5, prose(1, 40)), (6, prose(1, 40)),
        (7, prose(2, 3000)), (8, "x"), (9, "7 11 !!")]


# ---- language identification

def test_language_scores_match_a_plain_model(spark):
    texts = {"de": "der die und ist nicht", "en": "the of and is not", "fr": "le la et est pas"}
    rows = [(i, f"{texts[k]} {prose(i, 3)}" if k == "en" else texts[k] * (i % 3 + 1), k)
            for i, k in enumerate(list(texts) * 20)]
    docs = documents(spark, rows)
    model = language_id.fit(docs, orders=(1, 2), bits=12)
    assert model.languages == ("de", "en", "fr")

    def buckets(text):
        codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        out = []
        for order in (1, 2):
            for i in range(len(codes) - order + 1):
                gram = codes[i:i + order]
                if any(chr(c).isalpha() for c in gram):
                    h = 0
                    for c in gram:
                        h = (h + c + 1) * 0x9E3779B97F4A7C15 % 2**64
                        h ^= h >> 31
                    out.append((h * 0xD6E8FEB86659FD93 % 2**64) >> 52)
        return out

    counts = np.zeros((3, 4096))
    for _, text, lang in rows:
        np.add.at(counts[model.languages.index(lang)], buckets(text), 1)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    assert np.allclose(logs, model.weights)
    names, scores = language_id.score_texts(["la pas und", "", "12 !", "die"], model)
    totals = logs[:, buckets("la pas und")].sum(1) + math.log(1 / 3)
    share = np.exp(totals - totals.max())
    assert names[0] == model.languages[totals.argmax()]
    assert scores[0] == pytest.approx(share.max() / share.sum())
    assert names[1:3] == ["und", "und"] and list(scores[1:3]) == [0, 0] and names[3] == "de"


def test_language_of_a_text_in_pieces(spark, monkeypatch):
    docs = documents(spark, [(i, prose(i, 30), "en" if i % 2 else "xx") for i in range(10)])
    model = language_id.fit(docs)
    text = prose(99, 500)
    whole = language_id.score_texts([text, "ab"], model)
    monkeypatch.setattr(language_id, "_PIECE", 97)
    parts = language_id.score_texts([text, "ab"], model)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_language_edges(spark):
    rows = [(*r, "en" if r[0] % 2 else None) for r in EDGE] + [(None, "the thing", "en")]
    out = {r.doc_id: r for r in language_id.identify(documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
               for i, r in out.items())
    nothing = documents(spark, [(1, "abc")])
    assert language_id.identify(nothing).first().lang_pred == "und"
    assert language_id.keep_known(nothing).count() == 1
    assert language_id.identify(documents(spark, [])).count() == 0
    assert language_id.keep_known(documents(spark, rows)).columns == documents(spark, []).columns


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count() > 0


# ---- byte-level BPE

@pytest.fixture(scope="module")
def codec():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), byte_bpe.Decoder(ranks), reference


def test_bpe_matches_the_library(codec, monkeypatch):
    encoder, decoder, reference = codec
    rng = random.Random(4)
    parts = ["a", "the ", "  ", "\n", "é", "ß", "日本", "😀", "12", "!!", "'s", "er", "XYZ", "\0", "aaaa"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = encoder.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert decoder.to_bytes(ids).decode() == text
        assert "".join(decoder.stream(ids[i:i + 1] for i in range(len(ids)))) == text
    monkeypatch.setattr(encoder.machine, "_most_states", 5)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    assert encoder.encode(long).tolist() == reference.encode_ordinary(long)


def test_bpe_borders_follow_the_merge_rule(codec):
    machine, rng = codec[0].machine, random.Random(8)
    ranks = list(machine._bytes)
    for _ in range(2000):
        a, b = rng.choice(ranks), rng.choice(ranks)
        assert machine._no_crossing(a, b) == (
            machine.merge(machine._bytes[a] + machine._bytes[b]) == [a, b])


def test_utf8_machine_on_broken_bytes():
    for data in (b"\xe6\x97", b"a\xffb", b"\xf0\x9f\x98\x80", b"\xc3(", b"\xed\xa0\x80x", b"\xe2\x82\xac"):
        for cut in range(len(data) + 1):
            machine = byte_bpe.Utf8Machine()
            pieces = [machine.feed(data[:cut]), machine.feed(data[cut:]), machine.close()]
            assert "".join(p.decode("utf-8", "replace") for p in pieces) == data.decode(
                "utf-8", "replace")


def test_bpe_rows(spark, codec):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(documents(spark, EDGE), path, pattern)
    rows = {r.row.doc_id: r for r in coded.collect()}
    for i, text in EDGE:
        ids = codec[2].encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids == ids and rows[i].round_trip
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decode(coded.select(F.col("row.doc_id").alias("doc_id"), "ids"), path, slice_ids=3)
    assert {r.row.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in EDGE}
    assert byte_bpe.encode(documents(spark, []), path, pattern).count() == 0


# ---- URL filters

def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/En/x?y#z", "https://example.com/en/1",
            "x://www.example.com/en/", "http://example.net/es/5", "http://net/fr/#a", "http://com",
            "http://a.com/x", "http://mynet.org/es/", "http://é.net?q=/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)],
                                  "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           url_templates.judge_urls(pages).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.com", "/En/x", "com/", "allow"),
        4: ("example.com", "/en/1", "example.com/en/", "block"),
        5: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        6: ("example.net", "/es/5", "net/es/", "block"), 7: ("net", "/fr/", "net/fr/", "block"),
        8: ("com", "", None, "allow"), 9: ("a.com", "/x", "com/", "allow"),
        10: ("mynet.org", "/es/", None, "allow"), 11: ("é.net", "", None, "allow"),
    }
    assert url_templates.judge_urls(pages.limit(0)).count() == 0


def test_url_templates_generalise_merge_and_reject(spark):
    rows = [(i, f"http://h.org/spam/{i}") for i in range(40)]
    rows += [(100 + i, f"http://h.org/junk/{i}") for i in range(40)]
    rows += [(200 + i, f"http://h.org/news/{i}") for i in range(40)]
    rows += [(300 + i, f"http://h.org/users/name{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i // 26 + 1)}")
             for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(
        [(i, True) for i in range(30)] + [(100 + i, True) for i in range(25)]
        + [(200 + i, False) for i in range(30)], "page_id long, rejected boolean")
    got = url_templates.judge_urls(pages, rules=(), labels=labels).collect()
    verdict = {r.page_id: r.verdict for r in got}
    assert all(verdict[i] == "block" for i in [*range(40), *range(100, 140)])
    assert all(verdict[i] == "allow" for i in [*range(200, 240), *range(300, 360)])
    template = {r.page_id: r.template for r in got}
    assert template[0] == template[100] == "/junk|spam/*" and template[200] == "/news/*"
    assert template[300] == template[359] == "/users/*"


def test_url_templates_without_labels_have_their_parents_purity(spark):
    rows = [(i, f"http://bad.org/{'ab'[i % 2]}/x{i}") for i in range(120)]
    rows += [(200 + i, f"http://bad.org/c/d/{i}/e/f/{'gh'[i % 2]}") for i in range(10)]
    rows += [(300 + i, f"http://good.org/{'ab'[i % 2]}/x{i}") for i in range(600)]
    rows += [(1000, "http://good.org/c"), (1001, "http://new.org/"), (1002, "http://other.io/"),
             (1003, None), (1004, "http://bad.org"), (1004, "http://bad.org"), (None, "http://bad.org/c")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(
        [(i, True) for i in range(120)] + [(300 + i, False) for i in range(600)],
        "page_id long, rejected boolean")
    got = url_templates.judge_urls(pages, rules=(), labels=labels).collect()
    assert len(got) == len(rows)
    verdict = {r.page_id: r.verdict for r in got}
    # Nothing below /c of the blocked host has a label; it is judged by its parent.
    assert all(verdict[i] == "block" for i in [*range(120), *range(200, 210), 1004, None])
    assert all(verdict[i] == "allow" for i in [*range(300, 900), 1000, 1001, 1002, 1003])
    by_id = {r.page_id: r for r in got}
    assert by_id[200].template == "/c/d/*/e/f/g" and by_id[201].template == "/c/d/*/e/f/h"
    assert by_id[200].evidence == 0 and by_id[0].evidence == 120
    assert len({r.purity for r in got if not r.evidence}) > 3


def test_url_templates_equal_sql_on_deep_paths(spark):
    rng, rows = random.Random(11), []
    for i in range(1500):
        host = rng.choice(["a.net", "b.net", "x.example.com", "c.org", "www.example.com", "d.io"])
        deep = [rng.choice(["es", "fr", "en", "q|r", "*", f"n{i}"]) for _ in range(rng.randrange(7))]
        if rng.random() < 0.3:
            deep = [rng.choice(["es", "en"]), *["".join(rng.choices("abcde", k=4)) for _ in range(3)]]
        if i % 100 < 2:
            deep = ["long"] * 300 + deep
        rows.append((i, f"https://{host}/{'/'.join(deep)}{rng.choice(['', '/', '?a=/b', '#/es'])}"))
    rows += [(1501, None), (1502, ""), (1503, "nothing"), (1504, "x://"), (1505, "x:///es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    base = duckdb.connect()
    base.register("pages", pages.toPandas())
    want = base.sql(url_template_sql()).df()
    got = url_templates.judge_urls(pages).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order and len(got) == len(rows)
    both = [f[order].sort_values("page_id").reset_index(drop=True) for f in (got, want)]
    pd.testing.assert_frame_equal(*both, check_dtype=False)


def test_native_plans(spark, sf):
    for frame in (
        url_templates.judge_urls(spark.read.parquet(f"{sf}/pages.parquet")),
        license_rules.find_licences(spark.read.parquet(f"{sf}/documents.parquet")),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# ---- exact duplicates

def brute_groups(rows):
    groups = {}
    for i, text in rows:
        key = (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(key, []).append((-len(text or ""), i is None, i or 0))
    return {key: (min(members), len(members)) for key, members in groups.items()}


def test_exact_groups(spark):
    rows = EDGE + [(20, "a b"), (10, "a  b"), (11, " a b "), (12, "ab"), (13, " a b "), (None, "ab"),
                   (30, "same"), (30, "same"), (40, "\u00a0"), (None, "lonely")]
    got = exact_dedup.exact_groups(documents(spark, rows)).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        (_, none, first), size = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (None if none else first, size)
    kept = exact_dedup.drop_copies(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and kept.count() == len(want)
    assert {r.doc_id for r in kept.collect()} == {
        None if none else i for (_, none, i), _ in want.values()}
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_cuckoo_index_keeps_every_digest():
    index, rng, live = exact_dedup.CuckooIndex(2), random.Random(3), {}
    for step in range(5000):
        digest = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if digest in live and rng.random() < 0.4:
            assert index.delete(digest)
            del live[digest]
        elif digest not in live:
            index.insert(digest, step)
            live[digest] = step
        assert (index.find(digest) or [None, None])[1] == live.get(digest)
    assert index.resizes and index.live == len(live)
    assert {d: v for d, v in index.entries()} == live


def test_cuckoo_index_with_equal_fingerprints():
    # All digests share fingerprint and buckets: only the stored digest tells them apart.
    index = exact_dedup.CuckooIndex(64)
    same = [bytes(10) + i.to_bytes(22, "big") for i in range(8)]
    for i, digest in enumerate(same):
        index.insert(digest, i)
    assert [index.find(d)[1] for d in same] == list(range(8))
    assert index.find(bytes(10) + b"\1" * 22) is None and not index.delete(bytes(31) + b"\x63")


def test_index_changes(spark):
    groups = lambda rows: exact_dedup.live_groups(exact_dedup.row_digests(documents(spark, rows)))
    index = groups([(1, "a"), (2, "b"), (3, "b")])
    gone = exact_dedup.row_digests(documents(spark, [(9, "b"), (9, "never there")]))
    got = exact_dedup.apply_changes(index, groups([(4, "a"), (5, "c")]), gone).collect()
    assert sorted((r.keep_id, r.copies) for r in got) == [(1, 2), (5, 1)]


# ---- suffix array dedup

def test_suffix_order_and_longest_earlier():
    rng = random.Random(0)
    for _ in range(500):
        s = [rng.randint(1, rng.choice((1, 2, 4))) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_sort.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
        weight = [rng.randint(1, 5) for _ in range(5)]
        known = suffix_sort.longest_earlier(s, [weight[x] for x in s])
        for i in range(len(s)):
            best = 0
            for j in range(i):
                k = 0
                while i + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, sum(weight[x] for x in s[i:i + k]))
            assert known[i] == best


def brute_removal(rows, length):
    first, out = {}, {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i:i + length], (doc, i))
    for doc, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] != (doc, i):
                covered[i:i + length] = b"\1" * length
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out[doc] = (len(data), sum(covered), spans, kept)
    return out


@pytest.mark.parametrize("piece, most_runs, length, anchor", [
    (1 << 20, 2000, 100, 56), (150, 2000, 100, 56), (1 << 20, 3, 100, 56), (1 << 20, 2000, 20, 11)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, piece, most_runs, length, anchor):
    monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 600))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            if text:
                text[rng.randrange(len(text))] = "X"
        text = "".join(text)
        if rng.random() < 0.3:
            text = text[rng.randint(0, 200):] + rng.choice(base)[:rng.randint(0, 300)]
        rows.append((rng.randint(0, 10**6) * 100 + i, text))
    rows += [*EDGE, (-5, "a" * 500), (50, "ab" * 300), (60, "a" * 250 + "b" * 250)]
    got = suffix_dedup.remove_repeats(
        documents(spark, rows), length=length, anchor=anchor, most_runs=most_runs, with_kept=True)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == (
        brute_removal(rows, length))


def test_suffix_dedup_edges(spark):
    got = suffix_dedup.remove_repeats(documents(spark, [(None, "a" * 300), (1, "a" * 150)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 1: 149}
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


# ---- licences

def test_licences(spark):
    grant = license_rules.SENTENCES
    rows = [
        (1, "Intro. Released under the MIT  License. More"), (2, "released UNDER the mit license"),
        (3, "Code licensed under the Apache License, Version 2.0."), (4, None), (5, ""),
        (6, f"{grant['mit-grant']}\n{grant['mit-condition']}\nx.\n{grant['no-warranty']}"),
        (7, f"{grant['no-warranty']}\n{grant['mit-condition']}\n{grant['mit-grant']}"),
        (8, "A. Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.\n" * 2),
        (None, "Released under the MIT License."),
    ]
    got = {(r.doc_id, r.licence): r for r in
           license_rules.find_licences(documents(spark, rows)).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (6, "MIT"), (8, "CC-BY-NC-4.0"), (8, "Apache-2.0"),
                        (None, "MIT")}
    assert got[1, "MIT"].first_at == 1
    assert got[8, "Apache-2.0"].sentences == " ".join(["cc-by-nc-4-notice apache-2-notice"] * 2)
    assert license_rules.find_licences(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_rules.find_licences(documents(spark, []), known={"x": "Anything goes."}).count()


def test_licences_over_several_lines(spark):
    known = license_rules.ALL_SENTENCES

    def wrapped(*names, width=70, prefix="", end="\n"):
        return f"{end}{prefix.rstrip()}{end}".join(
            end.join(prefix + line for line in textwrap.wrap(known[n], width)) for n in names)

    gpl2 = ("This program is free software; you can redistribute it and/or modify\n"
            "it under the terms of the GNU General Public License as published by\n"
            "the Free Software Foundation; either version 2 of the License, or\n"
            "(at your option) any later version.\n")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A\n\n" + wrapped("mit-grant", "mit-condition")),
        (2, "Copyright (c) 2020 A\n" + wrapped("mit-grant", "mit-condition", end="\r\n")),
        (3, wrapped("bsd-redistribute") + "\n\n1. Some condition.\n\n3. " + wrapped("bsd-endorse")),
        (4, gpl2), (5, gpl2.replace("GNU General", "GNU Lesser General").replace("n 2", "n 2.1")),
        (6, wrapped("agpl-head-3", prefix=" * ")), (7, wrapped("isc-grant", width=40)),
        (8, "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0."
            " If a copy of the MPL was not distributed with this\n// file, You can obtain one at"
            " https://mozilla.org/MPL/2.0/."),
        (9, wrapped("unlicense-public", width=30)), (10, "BSD 2-Clause License\n\n" + rows_bsd(wrapped)),
        (11, wrapped("mit-grant").replace("hereby\n", "hereby ").replace("sell", "sell\n\n")),
        (12, "Code\nlicensed under the MIT License. All\nRights Reserved."),
        (13, "Intro\nReleased under the MIT License\nmore words"),
    ]
    got = {(r.doc_id, r.licence): r for r in
           license_rules.find_licences(documents(spark, rows)).collect()}
    assert set(got) == {
        (1, "MIT"), (2, "MIT"), (3, "BSD-3-Clause"), (4, "GPL-2.0-or-later"),
        (5, "LGPL-2.1-or-later"), (6, "AGPL-3.0-or-later"), (7, "ISC"), (8, "MPL-2.0"),
        (9, "Unlicense"), (10, "BSD-2-Clause"), (12, "MIT"), (13, "MIT")}
    assert got[2, "MIT"].first_at == 1 and got[13, "MIT"].first_at == 1


def rows_bsd(wrapped):
    return wrapped("bsd-redistribute") + "\n\n1. Redistributions must.\n"


# ---- chunks

def test_chunks_do_not_depend_on_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(97, 110, 5000, dtype=np.uint8).tobytes()
    h, want = 0, []
    for b in data:
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 65536
        want.append(h)
    assert chunk_dedup.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == want
    ends, last = [], 0
    for i, h in enumerate(want):
        if i + 1 - last == 256 or (i + 1 - last >= 16 and h >> 11 == 0):
            last = i + 1
            ends.append(last)
    assert chunk_dedup.chunk_ends(data, 5, 16, 256) == sorted({*ends, len(data)})
    monkeypatch.setattr(chunk_dedup, "_PIECE", 37)
    assert chunk_dedup.chunk_ends(data, 5, 16, 256) == sorted({*ends, len(data)})
    shifted = chunk_dedup.chunk_ends(b"new " + data, 5, 16, 256)
    assert len({e - 4 for e in shifted} & set(ends)) > 0.9 * len(ends)


def test_chunk_repeats_match_brute_force(spark):
    rng = random.Random(2)
    shared = [prose(50 + i, 60) for i in range(3)]
    rows = [(rng.randrange(10**6) * 50 + i, prose(1000 + i, 30) + " " + rng.choice(shared) * (i % 3)
             + prose(2000 + i, 20)) for i in range(40)] + EDGE + [(None, shared[0])]
    first, want = {}, set()
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data, start = (text or "").encode(), 0
        for end in chunk_dedup.chunk_ends(data, 5, 16, 256):
            if first.setdefault(data[start:end], (doc, start)) != (doc, start):
                want.add((doc, start, end - start))
            start = end
    got = chunk_dedup.chunk_repeats(documents(spark, rows)).collect()
    assert {(r.doc_id, r.start, r.size) for r in got} == want and len(got) == len(want)
    assert all(r.earlier <= r.doc_id for r in got)
    passages = chunk_dedup.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in passages} >= {6}
    assert all(r.n_bytes >= 100 for r in passages)
    assert chunk_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_passages_match_brute_force(spark):
    rng = random.Random(8)
    shared = [" ".join(rng.choice(WORDS) + str(rng.randrange(10**4)) for _ in range(52))
              for _ in range(5)]
    rows = [(3 * i, f"{prose(4000 + i, 40)} {shared[i % 5] if i % 4 else ''} {prose(5000 + i, 40)}"
             .replace("the", f"t{i}")) for i in range(60)]
    rows += [(1000, shared[0] * 4), (1001, None), (1002, ""), (None, shared[1]), (1003, "é" * 70000)]
    first, holders, runs = {}, {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data, start, last = (text or "").encode(), 0, None
        for end in chunk_dedup.chunk_ends(data, 4, 16, 256):
            owner = first.setdefault(data[start:end], (doc, start))
            holders.setdefault(data[start:end], set()).add(doc)
            if owner != (doc, start):
                last = start if last is None else last
                runs.setdefault((doc, last), []).append(data[start:end])
            else:
                last = None
            start = end
    want = {(doc, at, sum(map(len, run)), len(run))
            for (doc, at), run in runs.items() if sum(map(len, run)) >= 100}
    got = chunk_dedup.repeated_passages(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(want) and want == {
        (r.doc_id, r.start, r.n_bytes, r.n_chunks) for r in got}
    assert all(r.earlier_doc_id <= r.doc_id and any(
        r.earlier_doc_id in holders[c] for c in runs[r.doc_id, r.start]) for r in got)
    # Every later document with a passage of 52 words is found.
    assert {r.doc_id for r in got} >= {3 * i for i in range(10, 60) if i % 4}


# ---- decontamination

def least_edits(item, text):
    row = np.arange(1) * 0
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + np.array([c != t for t in text], int))
        step = np.concatenate([[i], step])
        row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
    return int(row.min())


def test_short_items_are_found_as_whole_words(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["x = 1", "Yes", "ab ab", "42", "日本", "", " \t", "c++", "no\u00a0way", "Yes"]
    alphabet = ["yes", "YES", "ab", "x", "=", "1", "42", "420", "c++", "c++x", "日本", "no way", "no",
                "\n", "way", "yesno", "日本x", "(yes)"]
    rows = [(i, rng.choice([" ", "", "  "]).join(rng.choices(alphabet, k=rng.randrange(12))))
            for i in range(80)]
    rows += [(100, None), (101, ""), (102, "yes"), (103, "z " * 400 + "x = 1" + " z" * 400)]
    want = set()
    for doc, text in rows:
        text = decontamination.normalise(text or "")
        for item, needle in enumerate(map(decontamination.normalise, texts)):
            for at in range(len(text) - len(needle) + 1) if needle else ():
                end = at + len(needle)
                if text[at:end] == needle and not (
                        at and text[at - 1].isalnum() and needle[0].isalnum()) and not (
                        end < len(text) and text[end].isalnum() and needle[-1].isalnum()):
                    want.add((doc, item, 0, end))
                    break
    benchmark = spark.createDataFrame(
        [*enumerate(texts), (1, "Yes"), (20, None)], "item_id long, text string")
    got = decontamination.contaminated(documents(spark, rows), benchmark).collect()
    assert len(got) == len(want) and want == {tuple(r) for r in got}
    kept = decontamination.drop_contaminated(documents(spark, rows), benchmark).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in rows} - {i for i, *_ in want}
    items = decontamination.Items(list(range(len(texts))), texts, 10, 0.1)
    monkeypatch.setattr(decontamination, "_PIECE", 7)
    found = decontamination.find_items([t or "" for _, t in rows], items)
    assert {(row, items.ids[item], *rest) for row, item, *rest in found} == {
        (row, item, 0, end) for row, (doc, _) in enumerate(rows)
        for d, item, _, end in want if d == doc}


def test_items_are_found_within_the_budget(monkeypatch):
    rng = random.Random(2)
    texts = [prose(300 + i, rng.randint(12, 40)) for i in range(6)] + ["tiny", "Straße öffnen " * 3]
    items = decontamination.Items(list(range(len(texts))), texts, 10, 0.1)
    for piece in (1 << 19, 400):
        monkeypatch.setattr(decontamination, "_PIECE", piece)
        for trial in range(60):
            k = rng.randrange(len(items.texts))
            changed = list(items.texts[k])
            for _ in range(rng.randint(0, int(items.edits[k]) + 3)):
                at = rng.randrange(len(changed))
                changed[at:at + 1] = rng.choice((["z"], [], [changed[at], "y"]))
            text = f"{prose(trial, rng.randint(0, 90))} {''.join(changed).upper()}\n{prose(trial + 500, 20)}"
            found = {i: e for _, i, e, _ in decontamination.find_items([text], items)}
            for i, item in enumerate(items.texts):
                edits = least_edits(item, decontamination.normalise(text))
                assert found.get(i) == (edits if edits <= items.edits[i] else None)


def test_contaminated_documents(spark):
    item = prose(700, 25)
    bench = spark.createDataFrame(
        [(1, item), (2, item), (3, None), (4, ""), (5, "short"), (6, prose(701, 25))],
        "item_id long, text string")
    rows = EDGE + [(100, prose(5, 50) + "  " + item.replace(" ", "\n") + " end"), (None, item),
                   (101, item[:40])]
    got = decontamination.contaminated(documents(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {
        (100, 1, 0), (100, 2, 0), (None, 1, 0), (None, 2, 0)}
    many = decontamination.contaminated(documents(spark, rows), bench, block_chars=200).collect()
    assert sorted(map(str, many)) == sorted(map(str, got))
    kept = decontamination.drop_contaminated(documents(spark, rows), bench)
    assert kept.columns == documents(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in EDGE} | {101}
    assert decontamination.contaminated(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.contaminated(documents(spark, []), bench).count() == 0


# ---- SimHash

def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(
        " " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_find_all_within_four_bits():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**64, 500, dtype=np.uint64)

    def keys(values):
        table = {}
        for key, owner in zip(*(x.tolist() for x in simhash_golay._key_columns(values)), strict=True):
            table.setdefault(owner, set()).add(key)
        return table

    own = keys(prints)
    for bits in range(1, 5):
        other = prints.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        theirs = keys(other)
        assert all(own[int(a)] & theirs[int(b)] for a, b in zip(prints, other, strict=True))
    assert set(np.unique(simhash_golay._nearest_index(), return_counts=True)[1]) == {2048}


def test_near_groups_match_brute_force(spark):
    rng, rows = random.Random(9), list(EDGE)
    for g in range(12):
        words = prose(900 + g, 300).split()
        for i in range(rng.randint(1, 6)):
            changed = words[:]
            for _ in range(i):
                changed[rng.randrange(len(changed))] = "changed"
            rows.append((1000 + 10 * g + i, " ".join(changed) + "\x1c\u00a0Ä"))
    rows += [(5000, rows[-1][1].upper()), (None, rows[-1][1])]
    prints = [plain_print(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4 and part[a] != part[b]:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    got = simhash_golay.near_groups(documents(spark, rows)).collect()
    want = {(i, f"{f:016x}", min((rows[j][0] for j in range(len(rows)) if part[j] == p
                                  and rows[j][0] is not None), default=None))
            for (i, _), f, p in zip(rows, prints, part, strict=True)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = simhash_golay.drop_near_copies(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for i, _, c in want if i is not None} | {None}
    assert simhash_golay.near_groups(documents(spark, [])).count() == 0


def test_similar_documents_match_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(12):  # near copies far beyond four bits: up to a tenth of the shingles differ
        words = prose(300 + i, 60 + 40 * i).split()
        for j in range(5):
            copy = words[:]
            for _ in range(j * len(words) // 200 + (j > 0)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((1000 * j + 17 * i, " ".join(copy).upper() if j == 4 else " ".join(copy)))
    rows += [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "One  two"),
             (20_004, prose(999, 50)), (None, rows[0][1])]
    sets = {i: simhash_golay.shingle_set((t or "").encode(), 5) for i, t in rows if i is not None}
    links = {(a, b) for a in sets for b in sets
             if a < b and (n := len(sets[a] & sets[b])) and n >= 0.8 * len(sets[a] | sets[b])}
    far = sum(bin(simhash_golay.fingerprint_of(simhash_golay.shingle_hashes(t[0], 4))
                  ^ simhash_golay.fingerprint_of(simhash_golay.shingle_hashes(t[1], 4))).count("1") > 4
              for t in ([dict(rows)[i].encode() for i in pair] for pair in links))
    assert far > 20
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {(r.a, r.b) for r in simhash_golay.similar_links(documents(spark, rows)).collect()}
    assert {tuple(sorted(x)) for x in got} <= links
    kept = simhash_golay.drop_similar(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        i for i in root if root[i] == i)
    assert kept.where("doc_id is null").count() == 1 and kept.columns[-1] == "digest"
    assert simhash_golay.drop_similar(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 30)] + [(7, 7), (200, 5)]
    got = components.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()
    want = {n: 100 for n in range(100, 161)} | {n: 5 for n in [5, *range(6, 30), 200]}
    assert dict(got) == want and len(got) == len(want)
    assert components.smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_connects_what_is_linked():
    prints = np.random.default_rng(3).integers(0, 2**12, 200).astype(np.int64)
    left, right = simhash_golay.forest(np.unique(prints), 2)
    assert len(left) < len(np.unique(prints))
    assert (np.bitwise_count((left ^ right).view(np.uint64)) <= 2).all()


# ---- HTML

@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a < b and <3", "a < b and <3"),
    ("<p>Hello <b>wor</b>ld<br>more<p>Two &amp; three &#233;&nbsp;x", "Hello world more\nTwo & three é x"),
    ("<nav>a<article>no</article></nav><article><header><h1>T</h1></header><p>x<ul><li>a<li>b<ul>"
     "<li>c</ul></ul><div class='comments'><p>bad</p></div><footer>f</footer></article>tail",
     "T\nx\na\nb\nc"),
    ("<body>top<div class='sidebar x'>s<div>t</div></div><!-- <p>c --><p>mid</p><script>'<p>'</script>",
     "top\nmid"),
    ("<main>in<form><p>q</form> side</main>out", "in\nside"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<aside>never closed<p>a", ""),
    ("<div role=navigation>m</div><section id='cookie-notice'>c</section><p>x", "x"),
    ("<title>t</title><style>p{}</style><p title='a>b'>x</p></html>", "x"),
    ("<p>one</p>\n<p>two</p", "one\ntwo</p"),
])
def test_blocks(source, text):
    assert "\n".join(html_templates.blocks(html_templates.parse(source or ""))) == text


def test_deep_pages_are_read():
    root = html_templates.parse("<div>" * 20_000 + "x")
    html_templates.hash_subtrees(root)
    assert html_templates.blocks(root) == ["x"]


def test_site_templates_are_removed(spark):
    page = "<body><div><b>Join us</b> today</div><p>{}</p><p>Told {} times</p></body>"
    rows = [(i, f"http://a.org/{i}", page.format(prose(i, 5), i)) for i in range(30)]
    rows += [(100 + i, "http://b.org/", page.format("x", i)) for i in range(5)]  # too few pages
    rows += [(200 + i, "http://c.org/", page.format("same", 0)) for i in range(40)]  # one page only
    rows += [(300, None, None), (None, "http://a.org/", ""), (301, "http://a.org/", "<p>alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "host", F.lit("clash"))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in
           html_templates.extract_main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i, f"http://a.org/{i}"][0] == f"{prose(i, 5)}\nTold {i} times"
    assert got[100, "http://b.org/"][0] == "Join us today\nx\nTold 0 times"
    assert got[200, "http://c.org/"] == ("Join us today\nsame\nTold 0 times", 31)
    assert got[300, None] == ("", 0) and got[301, "http://a.org/"] == ("alone", 5)
    assert html_templates.extract_main_text(pages.limit(0)).count() == 0


WORDY = "The article tells of many things in long sentences, one after the other, to its end. "


@pytest.mark.parametrize(("page", "text"), [
    ("<div class='layout has-sidebar'><article><p>Body</p></article></div>", "Body"),
    ("<div class='no-header'><p>Body</p></div>", "Body"),
    ("<div class='entry-content share-enabled'><p>Body</p></div>", "Body"),
    ("<div class='sidebar-left wrapper'><main><p>Body</p></main></div>", "Body"),
    (f"<main><p>{WORDY}</p></main><div class='sidebar'><p>aside</p></div>", WORDY.strip()),
    (f"<p>{WORDY * 3}</p><ol class='reader-replies'><li><article>Nice!</article></ol>",
     (WORDY * 3).strip()),
    (f"<p>{WORDY}</p><div class='comments'><article>Nice!</article></div>", WORDY.strip()),
    ("<header>Site</header><article><header><h1>Title</h1></header>Body</article>", "Title\nBody"),
    ("<div class='nav-menu'>Home</div><p>Body</p><footer>Imprint</footer>", "Body"),
    ("<p>Body</p><div class='cookie-notice'>We use cookies</div>", "Body"),
])
def test_layouts(spark, page, text):
    pages = spark.createDataFrame([(1, "https://a.example/x", page)],
                                  "page_id long, url string, html string")
    assert html_templates.extract_main_text(pages).first().text == text


def test_broken_pages_take_linear_time():
    import time

    for piece in ("<nav>x<p>y", '<a href="x', "<div class='sidebar'>a<p>b", "<script>x", "<!-- x"):
        started = time.perf_counter()
        html_templates.parse(piece * (200_000 // len(piece)))
        assert time.perf_counter() - started < 5, piece
