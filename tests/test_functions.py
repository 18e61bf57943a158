import math

import pytest
from pyspark.sql import functions as F

from loomline.functions import code, text
from loomline.operators import captions


def ask(spark, column, *values, schema="a string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(column).collect()]


def test_times(spark):
    assert ask(spark, text.format_time("a"), 0.0, 3661.5, 61.25, -5.0, 59.9996, 360000.0, schema="a double") == ["00:00.000", "01:01:01.500", "01:01.250", "00:00.000", "00:60.000", "100:00:00.000"]
    assert ask(spark, text.format_srt_time("a"), 37.16, 3661.5, schema="a double") == ["00:00:37,159", "01:01:01,500"]
    assert ask(spark, text.format_vtt_time("a"), 1.25, schema="a double") == ["00:00:01.250"]
    assert ask(spark, text.parse_caption_time("a"), "00:00:01.500", " 01:02.5 align:start", "1:00:00", "x:y", "5", "") == [1.5, 62.5, 3600.0, None, None, None]


def test_cleaning(spark):
    assert ask(spark, text.clean_text("a"), " a\xa0 b\t\tc\r\n d ") == ["a b c\n d"]
    assert ask(spark, text.safe_filename("a"), "My: talk?.mp4", "", "नमस्ते", "x" * 300) == ["My_ talk_.mp4", "video", "_", "x" * 180]
    assert ask(spark, text.slugify("a"), "  Hello, World! ", "समवसरण", "a" * 69 + " bc") == ["hello-world", "video", "a" * 69]
    assert ask(spark, text.normalize_screen_text("a"), "If ( X )  :\n  “Y” = 3", "") == ['if(x):"y"=3', ""]


def grams(s):
    return {s[i : i + 2] for i in range(len(s) - 1)} or {s}


@pytest.mark.parametrize("a,b", [("abc def", "abc deg"), ("", ""), ("", "x"), ("a", "a"), ("a", "b"), ("hello world", "hello world"), ("नमस्ते", "नमस्कार")])
def test_similarity(spark, a, b):
    want = 1.0 if not a and not b else 0.0 if not a or not b else len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    (got,) = ask(spark, text.bigram_similarity("a", "b"), (a, b), schema="a string, b string")
    (back,) = ask(spark, text.bigram_similarity("b", "a"), (a, b), schema="a string, b string")
    assert math.isclose(got, want) and got == back


def test_snippets_and_addresses(spark):
    long = "x" * 60 + "Needle" + "y" * 60
    assert ask(spark, text.snippet("a", "needle"), long) == ["x" * 40 + "Needle" + "y" * 40]
    assert ask(spark, text.snippet("a", ""), long) == ["x" * 40]
    urls = ["https://youtu.be/a", "http://WWW.YouTube.com/watch?v=1", "ftp://youtu.be/a", "https://example.com", "not a url", "", None]
    assert ask(spark, text.allowed_video_url("a"), *urls) == [True, True, False, False, False, False, False]
    assert ask(spark, text.watch_url("a", "b"), ("https://x", "1"), ("raw", "2"), (None, "3"), schema="a string, b string") == ["https://x", "https://www.youtube.com/watch?v=2", "https://www.youtube.com/watch?v=3"]


PROGRAMS = {
    "python": "def area(r):\n    import math\n    return self.pi * r\n",
    "javascript": "const a = require('x');\nfunction f(b) {\n  console.log(b);\n}",
    "typescript": "interface Row { id: number }\ntype Id = string\nenum Kind { A }",
    "java": "public class A {\n  private int b = 1;\n  public static void main(String[] c) { System.out.println(b); }\n}",
    "cpp": "#include <vector>\nstd::cout << 1;\nnamespace q {}",
    "go": "package main\nfunc f() { fmt.Println(1)\n x := 2 }",
    "rust": "pub fn f() { let mut a = 1; println!(\"{}\", a); }",
    "sql": "SELECT a, b FROM t\nJOIN u ON t.i = u.i\nWHERE a > 1\nGROUP BY a",
    "shell": "#!/bin/bash\nsudo pip install x\ngit clone y",
    "html": "<!DOCTYPE html><p class=\"q\">x</p>",
    "css": "@media print\n.box {\n#id {\ncolor: red;\nmargin: none;\n",
}


def test_programming_languages(spark):
    got = ask(spark, code.programming_language(F.col("a")), *PROGRAMS.values(), "", "The weather is fine today.", None)
    assert [g["language"] for g in got] == [*PROGRAMS, "unknown", "unknown", "unknown"]
    assert got[len(PROGRAMS)]["score"] == 0.0


def test_code_heuristics(spark):
    values = ("def f(x):\n    return x", "We walk to the park and talk.", "", None, "let a = 1;")
    assert ask(spark, code.looks_like_code(F.col("a")), *values) == [True, False, False, False, True]
    assert ask(spark, code.is_code_block(F.col("a")), *values) == [True, False, False, False, True]
    assert ask(spark, code.is_code_line(F.col("a")), "x = 1", "// hi", "plain words here", "", "f(x);") == [True, True, False, False, True]


def test_languages(spark):
    assert ask(spark, captions.resolve_language(F.col("a")), " Gujrati", "auto", "prakrit", "xx") == ["gu", None, None, None]
    assert ask(spark, captions.language_name(F.col("a")), "hi", "zz", "", None) == ["Hindi", "zz", "Undetermined", "Undetermined"]
    assert ask(spark, captions.is_known_alias(F.col("a")), "auto", "xx") == [True, False]
