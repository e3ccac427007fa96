"""Character references against html.unescape."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from tessera.functions.entities import unescape
from tessera.functions.text import clean_text


def decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").repartition(4)
    return [r.u for r in df.select("i", unescape(F.col("s")).alias("u")).orderBy("i").collect()]


def test_every_name(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&{n}" for n in html5] + [f"x &{n.rstrip(';')} &{n.rstrip(';')}=1" for n in html5]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_numbers(spark):
    numbers = [*range(0, 0x120), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x1F600,
               0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 0x99999999, 10**12, 10**30]
    texts = [t for n in numbers for t in (f"&#{n};", f"&#{n}x", f"&#x{n:x};", f"&#X{n:X} ", f"&#000000000000{n};", f"&#x00000000000{n:x}g")]
    texts += ["&#;", "&#x;", "&#xg;", "&", "&&", "&;", "&#", "& amp;", "&amp", "&ampamp;", "&amp;lt;", "&notit;", "&notin;", "&unknown;", "&AMP&amp&Amp;", None, "", "no", "&" + "a" * 40 + ";",
              "&" + "lt" + "b" * 31, "&é;", "& ", "&lt\n", "&#٣;"]
    assert decoded(spark, texts) == [t and html.unescape(t) for t in texts]


def test_generated(spark):
    rnd = random.Random(1)
    names = list(html5)
    bits = ["&", ";", "#", "x", "X", "amp", "lt", "not", "1", "9f", "80", " ", "\n", "é", "<", "😀", "a", "A"]
    texts = ["".join(rnd.choice(bits) if rnd.random() < 0.8 else "&" + rnd.choice(names)[: rnd.randrange(1, 9)] for _ in range(rnd.randrange(1, 14))) for _ in range(4000)]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_no_python_in_the_plan(spark):
    plan = spark.createDataFrame([("a",)], "s string").select(clean_text("s").alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert plan.count("str_to_map") == plan.count("str_to_map(lambda ")  # the table itself is a constant
