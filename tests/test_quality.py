"""Quality metrics: golden values and small models."""

import random
from collections import Counter

import pytest

from textloom.operators import quality


def scores(spark, pairs, **options):
    frame = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id int, candidate string, "
                                                       "reference string")
    rows = quality.chrf(frame, **options).collect()
    return [r.chrf for r in sorted(rows, key=lambda r: r.pair_id)]


def test_chrf_golden(spark):
    got = scores(spark, [("abc", "abc"), ("abc", "xyz"), ("", ""), ("", "abc"), ("abc", ""),
                         ("a b\n c", "ab c"), ("abc", "abd")])
    assert got == pytest.approx([100, 0, 0, 0, 0, 100, 350 / 9])


def test_chrf_beta_weighs_recall(spark):
    assert scores(spark, [("ab", "abc")], beta=2)[0] < scores(spark, [("ab", "abc")], beta=1)[0]
    with pytest.raises(ValueError):
        scores(spark, [("a", "b")], beta=0)


def test_chrf_by_hand(spark):
    # "aab" and "abb" share a, b, then ab: precision and recall are 2/3, 1/2 and 0.
    share = (2 / 3 + 1 / 2 + 0) / 3
    assert scores(spark, [("aab", "abb")])[0] == pytest.approx(100 * share)
    # "ab" in "abcd": all of its grams, of the four and three there are; longer orders are absent.
    p, q = 1.0, (2 / 4 + 1 / 3) / 2
    assert scores(spark, [("ab", "abcd")])[0] == pytest.approx(100 * 5 * p * q / (4 * p + q))


def test_chrf_properties(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab c\u00e9漢🙂", k=rng.randint(7, 40))) + "ab" for _ in range(120)]
    other = texts[1:] + texts[:1]
    whole = scores(spark, list(zip(texts, texts, strict=True)))
    assert whole == pytest.approx([100] * len(texts))
    # With beta 1 precision and recall weigh the same, so the sides can change places.
    there = scores(spark, list(zip(texts, other, strict=True)), beta=1)
    back = scores(spark, list(zip(other, texts, strict=True)), beta=1)
    assert there == pytest.approx(back) and all(0 <= x <= 100 for x in there)
    spaced = [" \n".join(t) for t in texts]
    assert scores(spark, list(zip(spaced, other, strict=True)), beta=1) == pytest.approx(there)


def test_char_ngrams(spark):
    frame = spark.createDataFrame([("a b\u00e9",)], "t string")
    rows = quality.char_ngrams(frame, "t", 3).collect()
    assert Counter((r.order, r.gram) for r in rows) == Counter(
        [(1, "a"), (1, "b"), (1, "é"), (2, "ab"), (2, "bé"), (3, "abé")])


def literals(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = quality.extract_literals(frame, "t").orderBy("id", "position").collect()
    return [[(r.category, r.token) for r in rows if r.id == i] for i in range(len(texts))]


def test_literals_in_priority_order(spark):
    found = literals(spark, "{{id}} %s [NAME] 2024-12-31 31/12/2024 $12.50 EUR 80 15% 42")[0]
    assert [c for c, _ in found] == ["placeholder"] * 3 + ["date"] * 2 + ["currency"] * 2 + [
        "number"] * 2
    assert literals(spark, "[2024-01-02]")[0] == [("placeholder", "[2024-01-02]")]


@pytest.mark.parametrize(("sentence", "expected"), [
    ("Pay 3,50 now", ["3,50"]), ("on 3.5.2021, not 3.5.21x", ["3.5.2021", "3.5"]),
    ("-7 and +8 %", ["-7", "+8 %"]), ("a1 b_2 3c", []), ("usd 5.", ["usd 5."]),
    ("5 usd or 6usd", ["5 usd", "6usd"]), ("{{ a }}{{b}} {c}", ["{{ a }}", "{{b}}"]),
    ("[x] [] [[y]]", ["[x]", "[]", "[y]"]), ("٣٤ und ٥%", ["٣٤", "٥%"]),
    ("v1.2.3 1.2.3", ["2.3", "1.2.3"]), ("€ 1.000,00 / 2.000 €", ["€ 1.000,00", "2.000 €"]),
    ("%s%d %%s", ["%s", "%s"]), ("1\u00a0% 2\u2003kg", ["1\u00a0%", "2"]),
])
def test_literals_of_a_sentence(spark, sentence, expected):
    assert [token for _, token in literals(spark, sentence)[0]] == expected


def test_long_texts_do_not_exhaust_the_regex_stack(spark):
    numbers, cells = "1" + ",1" * 50_000, "[" + "a" * 200_000 + "]"
    assert literals(spark, numbers, cells) == [[("number", numbers)], [("placeholder", cells)]]


def kept(spark, source, translated):
    frame = spark.createDataFrame([(1, source, translated)], "pair_id int, source string, "
                                                             "translated string")
    return {r.category: (r.preserved_count, r.source_count, r.preservation_percent)
            for r in quality.preservation(frame).collect()}


def test_preservation(spark):
    assert kept(spark, "12, 12, 34", "34, 12")["number"][:2] == (2, 3)
    assert kept(spark, "none", "1")["overall"] == (0, 0, None)
    assert kept(spark, "USD 12", "usd 12")["currency"] == (0, 1, 0.0)
    order = kept(spark, "Order {{id}} on 2024-12-31 costs $12.50 and $12.50; %s [NAME]",
                 "Auftrag {{id}} am 2024-12-31 kostet $12.50; %s [NAME]")
    assert order["placeholder"] == (3, 3, 100.0) and order["date"] == (1, 1, 100.0)
    assert order["currency"] == (1, 2, 50.0) and order["number"] == (0, 0, None)
    assert order["overall"][2] == pytest.approx(500 / 6)


def test_quality_report_modes(spark):
    frame = spark.createDataFrame(
        [(1, "a 1", "b 1", "b 1", None), (2, "hello 2", "hallo", None, "hello 2")],
        "pair_id int, source string, translated string, reference string, round_trip string")
    rows = {r.pair_id: r for r in quality.quality_report(frame).collect()}
    assert (rows[1].mode, rows[1].chrf, rows[1].preservation_percent) == ("reference", 100, 100)
    assert (rows[2].mode, rows[2].chrf, rows[2].preservation_percent) == (
        "back_translation", 100, 0)
