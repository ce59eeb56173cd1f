"""Text helpers."""

import html

from pyspark.sql import functions as F

from rosterlake.functions import text


def test_character_references_are_decoded_once(spark):
    whole = ["a &amp;lt; &lt; b", "&eacute;&#233;&#xE9;&#128;&#150;&#129;", "&#0;&#55296;&#1114112;", "&nosuch; &AMP; x", "&#x1F600; &notin; &NotEqualTilde;", "&#38;lt;", "plain", "", "&nbsp;&quot;&#39;&#x27;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*whole, None])], "i int, t string").orderBy("i")
    assert [r.d for r in rows.select(text.decode_entities("t").alias("d")).collect()] == [*map(html.unescape, whole), None]
    assert rows.select(text.decode_entities(F.lit("&amp and &#38")).alias("d")).first().d == "&amp and &#38"  # unfinished ones stay


def test_clean_text_collapses_what_entities_leave(spark):
    row = spark.range(1).select(text.clean_text(F.lit("  a&nbsp;&#9;b\x07c &#x2003; d ")).alias("t"), text.clean_text(F.lit("abcdef"), 3).alias("s")).first()
    assert (row.t, row.s) == ("a b c d", "abc")


def test_keywords_are_taken_as_they_are(spark):
    rows = spark.createDataFrame([("what is c++ (now)",), ("cat a.b",), ("axb",), (None,)], "t string")
    assert [r.k for r in rows.select(text.keyword_flag("t", ["a.b", "is c"]).alias("k")).collect()] == [True, True, False, None]
