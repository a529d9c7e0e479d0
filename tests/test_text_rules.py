import pytest
from pyspark.sql import functions as F

from propval.functions import regex as X
from propval.functions import rules as R
from propval.operators import clean as C

TEXTS = ["", "north   coast", "north", "ras hekma", "ras el hekma", "rasel hekma", "a compound here", "compounds", "كمبوند كبير",
         "villa", "ivillas", "see www.x.example/a and http://y", "www", "deliver in 8 years", "٨ years", "year 8", "fully finish",
         "fullyfinish", "core & shell", "12 sqm", "sahel", None]
PATTERNS = [R.NORTH_COAST_PATTERN, R.COMPOUND_WORD, R.VILLA_WORDS, R.URL_PATTERN, R.COASTAL_PATTERNS, R.RED_SEA_PATTERNS,
            R.INSTALL_YEARS, R.DP_MILLION, R.SIZE_SQM, *[p for p, _ in R.FINISH_RULES], *[p for p, _ in R.VIEW_RULES]]


@pytest.mark.parametrize("branch, word", [
    (r"ras\s*el?\s*hekma", "hekma"), (r"\bcompound\b", "compound"), (r"i?villa", "villa"), (r"www\.\S+", "www."), (r"ab+c", "ab"),
    (r"[abc]xyz{2}", "xy"), (r"(abc)de?", "d"), (r"(?i)abc", ""), (r"a|bcd", ""), (r"\d+", ""), (r"x(?:long)?y", "x"), (r"\x41bcd", "")])
def test_required_word(branch, word):
    assert X.required_word(branch) == word


def test_guarded_rules_match_as_the_regex(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cols = []
    for p in PATTERNS:
        plain = F.coalesce(F.col("t").rlike(X.java(p)), F.lit(False))
        cols += [plain == X.has("t", p), plain == X.has(F.col("t"), p)]
    assert all(all(r) for r in df.select(*cols).collect())
    assert "contains(`t`, 'coast')" in X.has_sql("t", r"a\s*coast") and "RLIKE" in X.has_sql("t", r"a\s*coast")


def test_strip_as_python_does(spark):
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    texts = [s + "a" + s + "b" + s * 2 for s in spaces] + ["".join(spaces), "", "\u200bx\u200b", " a\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.py_strip("t").alias("s"))
    assert [r["s"] for r in df.collect()] == [t if t is None else t.strip() for t in texts]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_location_parts_are_stripped(spark):
    rows = [(" a , b ,c ",), ("a,b",), (" a ",), ("",), (",",), (None,)]
    df = C.add_location(spark.createDataFrame(rows, "location string")).select("compound", "city", "governorate")
    assert [tuple(r) for r in df.collect()] == [("a", "b", "c"), ("a", "a", "b"), ("a", "a", "a"), ("", "", ""), ("", "", ""),
                                                ("Unknown",) * 3]


def test_rules_of_j1_are_compiled(spark):
    import __spark_entry__ as entry
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, "65535")
    entry._wrap(lambda s, d: s.range(1))(spark, "")
    assert int(spark.conf.get(name)) <= 8000
