"""Golden cases of text and identifier functions."""

import pytest
from pyspark.sql import functions as F

from standex.functions import ids, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("IS 269 : 1989", "IS 269: 1989"), ("IS 8112:1989", "IS 8112: 1989"), ("IS 459", "IS 459: 1992"), ("IS 1489(Part 2):1991", "IS 1489 (Part 2): 1991"),
        ("IS 2185 (Part 2) 1983", "IS 2185 (Part 2): 1983"), ("IS 2185 (Part 3)", "IS 2185 (Part 3): 1984"), ("IS 1489 (Part 9)", "IS 1489 (Part 9): 1991"),
        ("IS 99999", "IS 99999"), ("", ""), (" nothing ", "nothing"), (None, None), ("IS 2185 (Part 1) (Sec 2): 1990", "IS 2185 (Part 1): 1979"),
    ],
)
def test_format_standard_id(spark, raw, expected):
    assert one(spark, raw, ids.format_standard_id) == expected


@pytest.mark.parametrize(("raw", "key", "year"), [("IS 2185 (Part 1): 1979", "2185_part1", 1979), ("IS 269: 1989", "269", 1989), ("IS 383", "383", None), ("Odd", "odd", None)])
def test_base_key_and_year(spark, raw, key, year):
    assert (one(spark, raw, ids.base_key), one(spark, raw, ids.year_at_end)) == (key, year)


def test_valid_ids(spark):
    for raw, ok in (("IS 269: 1989", True), ("IS 99999", False), ("IS 2185 (Part 2): 1983", True), ("IS 269: 89", False)):
        assert one(spark, raw, ids.is_valid) is ok


def test_is_numbers(spark):
    assert one(spark, "See IS 269 and IS455 (Part 2): 1989", ids.is_numbers) == ["269", "455"]
    assert one(spark, "See IS455 (Part 2): 1989", lambda c: ids.is_numbers(c, ids.NUMBERS_LOOSE)) == ["455", "455(part2)"]
    assert one(spark, "thesis 45", ids.is_numbers) == []
    assert one(spark, None, ids.is_numbers) is None


def test_tokenize(spark):
    assert one(spark, "IS 2185 (Part 1): 1979", text.tokenize) == ["is2185", "2185", "part1", "part", "1979"]
    assert one(spark, "The é-test of ÄÖ, x", text.tokenize) == ["é-test", "äö"]
    assert one(spark, "", text.tokenize) == []


def test_expand_query(spark):
    got = one(spark, "43 grade cememnt opc", text.expand_query).split()
    assert got[:4] == ["43", "grade", "cement", "opc"] and "ordinary" in got and len(got) == len(set(got)) <= 20
    assert one(spark, "   ", text.expand_query) == ""


def test_query_category(spark):
    assert one(spark, "white portland cement", text.query_category) == "cement_white"
    assert one(spark, "hello", text.query_category) is None


def test_hints_are_off_by_default(spark):
    assert one(spark, "slag and white cement", text.domain_hints) == []
    assert one(spark, "slag and white cement", lambda c: text.domain_hints(c, True)) == ["IS 8042", "IS 455"]


def test_client_strings(spark):
    assert one(spark, "One. Two", text.first_sentence) == "One."
    assert one(spark, "No end", text.first_sentence) == "No end"
    assert one(spark, " a/b  c! ", text.safe_file_part) == "ab_c"
    assert one(spark, "!!!", text.safe_file_part) == "BIS_Export"
    assert one(spark, "Abc abc de the XYZ", text.expanded_terms) == ["Abc", "XYZ"]
