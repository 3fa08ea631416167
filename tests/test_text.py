"""Golden cases for names, titles, sizes and codes."""

import pytest
from pyspark.sql import functions as F

from contentlake.functions import text


def run(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["out"] for r in df.select("i", function(F.col("t")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("a[b]c", "ac"),
        ("a[b[c]d]e", "ae"),
        ("a]b[c]d", "a]bd"),
        ("a[b[c]d", "a"),
        ("[[[[[[[x]]]]]]]y", "y"),
        ("[[[[[[[x]]]]]]]y[z", "y"),
        ("a[" * 12 + "]" * 13 + "b", "a]b"),
        ("", ""),
        ("[", ""),
    ],
)
def test_brackets(spark, given, wanted):
    assert run(spark, text.drop_brackets, [given]) == [wanted]


def test_deep_brackets_are_exact(spark):
    import random

    rng = random.Random(4)
    given = ["".join(rng.choice("[[]]ab\n") for _ in range(rng.randrange(40))) for _ in range(400)]

    def model(s):
        depth, out = 0, ""
        for ch in s:
            if ch == "[":
                depth += 1
            elif ch == "]" and depth:
                depth -= 1
            elif not depth:
                out += ch
        return out

    assert run(spark, text.drop_brackets, given) == [model(s) for s in given]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Film (1999) x", "Film 1999  x"),
        ("Film(2099)x", "Film2099 x"),
        ("Film (1899) x", "Film  x"),
        ("Film (2100)", "Film "),
        ("Film ( 1999 ) (tag)", "Film 1999  "),
        ("a (b", "a (b"),
        ("a ((1999) b", "a  b"),
        ("a (x)y) b", "a y) b"),
    ],
)
def test_parens(spark, given, wanted):
    assert run(spark, text.keep_year_parens, [given]) == [wanted]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Show S01E02 720p", "Show"),
        ("S01 Show", "S01 Show"),
        ("S01 Show S02", "S01 Show S02"),
        (" S01 Show", " S01 Show"),
        ("Show Season 2 Complete", "Show"),
        ("Show EPISODE  7", "Show"),
        ("Bones1 x", "Bones1 x"),
        ("Show1S3 x", "Show"),
        ("Show 1ep4", "Show "),
    ],
)
def test_season(spark, given, wanted):
    assert run(spark, text.cut_at_season, [given]) == [wanted]


def test_strip_modes(spark):
    words = ["web", "dl", "hd"]
    given = ["my WEB dl", "cobweb web", "web web hd", "hd-hd hdx", None]
    exact = run(spark, lambda c: text.strip_keywords(c, words), given)
    # "cobweb" holds the first occurrence, so the free one stays; the third "hd" is part of a word
    assert exact == ["my  ", "cobweb web", "  ", "- hdx", None]
    whole = run(spark, lambda c: text.strip_keywords(c, words, "whole_word"), given)
    assert whole == ["my  ", "cobweb ", "  ", "- hdx", None]


def test_strip_keyword_with_regex_characters(spark):
    assert run(spark, lambda c: text.strip_keywords(c, ["c++", "a.b"], "whole_word"), ["x c++ a.b axb"]) == ["x   axb"]


def test_tidy_and_title(spark):
    assert run(spark, text.tidy, ["  a \t b - ( [ ", "-", "a\n"]) == ["a b", "", "a"]
    names = ["The.Film.(1999).1080p.BluRay.x264-GRP", "[Grp] Some_Show_S02E05_[x]", "Plain"]
    titles = run(spark, lambda c: text.extract_title(c, ["1080p", "bluray", "x264", "grp"]), names)
    assert titles == ["The Film 1999", "Some Show", "Plain"]
    assert run(spark, lambda c: text.extract_title(c, ["1080p"]), titles) == titles


def test_title_keywords_with_dots_never_match(spark):
    # separators became spaces before the keywords are tried
    assert run(spark, lambda c: text.extract_title(c, ["h.264"]), ["a H.264 b"]) == ["a H 264 b"]


def test_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1152, 1408, 1048575, 1 << 40, (1 << 50) * 3)], "n bigint")
    out = [r[0] for r in df.select(text.format_size(F.col("n"))).collect()]
    assert out == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.38 KB", "1024.00 KB", "1.00 TB", "3072.00 TB"]


def test_counts(spark):
    df = spark.createDataFrame([(n,) for n in (0, 999, 1000, 1234567, 1234567890)], "n bigint")
    assert [r[0] for r in df.select(text.format_count(F.col("n"))).collect()] == ["0", "999", "1,000", "1,234,567", "1234,567,890"]
    assert [r[0] for r in df.select(text.format_uptime(F.col("n"))).collect()][2] == "0:16"


def test_percent_codes(spark):
    given = ["a b*c~d/é", "%41%zz+%", "100%"]
    assert run(spark, text.percent_encode, given)[0] == "a%20b%2Ac~d%2F%C3%A9"
    assert run(spark, text.percent_decode, given)[1:] == ["A%zz %", "100%"]


def test_special_characters_are_bytes(spark):
    df = spark.createDataFrame([("ab é!",), ("",), ("-" * 2 + "a" * 8,), ("-" * 3 + "a" * 8,)], "t string")
    rows = df.select(text.special_count(F.col("t")), text.is_special_dense(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(3, True), (0, False), (2, False), (3, True)]


def test_ascii_lower_keeps_other_letters(spark):
    assert run(spark, text.ascii_lower, ["ABCÉ", "XYZ", "K"]) == ["abcÉ", "xyz", "K"]
