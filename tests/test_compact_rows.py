"""Compaction row by row: nothing but logs is shuffled once routed, and quick looks ahead of expressions change no result."""

from pyspark.sql import functions as F

from brevia.functions.redact import SECRETS, redact
from brevia.functions.text import text_of
from brevia.operators import prose
from brevia.operators.fidelity import TELLING, telling_tokens
from brevia.options import Options
from brevia.plans.pipeline import compact, store_rows

SENTENCES = ["It must go", "mustard", "a_must", "must_", "must́ go", "émust", "²must²", "Ⓐmust", "muſt be", "FAİL", "faıl now", "note‍", "‿note", "raises, raise2", "warning!", "none here", "हिnote", "\U0001f600error\U0001f600"]
TEXTS = [
    "", None, "plain words", *SENTENCES, "aKIA" + "A" * 16, "AKIA" + "B" * 16 + " x", "éAKIA" + "C" * 16, "²AKIA" + "C" * 16, "toKen=abcdefgh", "api_Key: abcdefgh", "paſſword = hunter22", "apıkey=abcdefgh",
    "xtoken=abcdefgh; my-secret : 'abcdefg'", "Bearer " + "a" * 20 + " token=" + "b" * 9, "bearer " + "a" * 20, "desk-" + "a" * 30, "sk-" + "a" * 30 + "́", "ghp_" + "a" * 40, "-----BEGIN PRIVATE KEY-----", "eyJ" + ".".join(["a" * 12] * 3),
    "a_b c-d e.f gH Hi éa.b a.bé x--y 3.5 ٣٤ 12,3 a1_b Abc ABĆ éAbc error FAİLED waıting returns a.b.c- _x_y x_ -a-",
]
MARKED = ["**a** b ", "a  b\t", "\t\nx", "a \nb", "\n\n\n\na", "a\n\n\nb", "__x__ _y_ *z", "a\t b", " ", "a\r\n b \r\n", "x \n\n\n\n *y* ", None, ""]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_prose_code_and_json_are_not_shuffled(spark):
    texts = ["First point is made here. Second point is not. " * 12, "def f():\n    return 1\n" * 20, '[{"a": 1}, {"a": 2}, {"a": 3}, {"a": 4}]', "x"]
    out = compact(frame(spark, texts), "id", "text", Options(min_tokens=5))
    assert sorted(r["kind"] for r in out.collect()) == ["code", "json", "passthrough", "text"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the union's part for logs is dealt by key and joined; no other part is
    assert prose.compact_prose(frame(spark, texts), "id", "text")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert plan.count("Join") == 1
    assert store_rows(out, F.current_timestamp()).count() == out.where("ref is not null").select("ref").distinct().count()


def test_looking_ahead_finds_the_same_secrets(spark):
    df = frame(spark, TEXTS)
    x, n = text_of(F.col("text")), F.lit(0)
    for _, pattern, mask in SECRETS:
        n = n + F.regexp_count(x, F.lit(pattern))
        x = F.regexp_replace(x, pattern, mask)
    got = redact(df).select("id", "redacted", "secrets").collect()
    assert sorted(got) == sorted(df.select("id", x.alias("redacted"), n.cast("long").alias("secrets")).collect())


def test_looking_ahead_finds_the_same_telling_tokens(spark):
    df = frame(spark, TEXTS)
    plain = F.transform(F.concat(*[F.regexp_extract_all(text_of(F.col("text")), F.lit(p), F.lit(1)) for p in TELLING]), F.lower)
    assert sorted(df.select("id", telling_tokens(F.col("text"))).collect()) == sorted(df.select("id", plain).collect())


def test_signals_are_those_of_the_expression(spark):
    rows = frame(spark, SENTENCES).select("text", F.col("text").rlike(r"(?iU)\b(must|should|never|always|error|fail|because|therefore|note|warning|important|return|raises?)\b").alias("told")).collect()
    assert [prose.signals(r["text"]) for r in rows] == [r["told"] for r in rows]
    for r in rows:  # the hints leave none out
        plain = prose.scores([("pad words here", False), ("more words here", False), (f"same {r['text']} same", False)])[2]
        assert (plain > prose.Decimal("0.6")) == (prose.signals(f"same {r['text']} same") or plain > 1), r["text"]


def test_scores_are_rounded_half_up():
    # 1 / 1024 has ten decimals and ends in five
    found = [("pad", False), ("pad", False), ("once", False), (" ".join(["pad"] * 1022), False)]
    assert prose.scores(found)[2] == prose.Decimal("0.000976563")


def test_normalized_as_by_the_expressions(spark):
    df = frame(spark, MARKED)
    x = F.regexp_replace(text_of(F.col("text")), r"(?d)(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1", "$2")
    for pattern, by in ((r"(?dm)[ \t]+$", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, by)
    assert sorted(df.select("id", prose.normalize(F.col("text"))).collect()) == sorted(df.select("id", x).collect())
