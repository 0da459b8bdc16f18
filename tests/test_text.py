from pyspark.sql import functions as F

from surveyloom.functions import text as T
from surveyloom.functions.ngrams import padded, padded_char_ngrams, word_ngrams, word_tokens
from surveyloom.functions.numbers import to_number


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]


def test_normalization(spark):
    cases = {
        "ёлка": "ёлка",
        "«да» — “нет”": '"да" - "нет"',
        "wait… ok.....": "wait... ok...",
        "a ​ b\t\n c ": "a b c",
        None: "",
        "Просто текст": "Просто текст",
    }
    for raw, want in cases.items():
        assert one(spark, raw, T.normalize_text) == want


def test_redaction_keeps_plain_text_and_counts(spark):
    cases = {
        "Пишите на anna.k+x@mail.example.kz!": ("Пишите на [REDACTED]!", 1),
        "тел +7 701 123 45 67": ("тел [REDACTED]", 1),
        "Билет БИ-123456, ID: 12345": ("Билет [REDACTED], [REDACTED]", 2),
        "см. https://a.example/x?y=1 и www.b.example": ("см. [REDACTED] и [REDACTED]", 2),
        "Обычный отзыв про 12 занятий": ("Обычный отзыв про 12 занятий", 0),
        "": ("", 0),
    }
    for raw, (want, n) in cases.items():
        assert one(spark, raw, T.redact) == want
        assert one(spark, raw, T.redaction_count) == n


def test_preprocess_equals_the_plain_expression(spark):
    rows = [("Hello  world… My mail: a@b.co. Really?!",), ("",), (None,), ("один два. три",), (" x y",)]
    frame = spark.createDataFrame(rows, "text_feedback string")
    out = T.preprocess(frame).withColumn("plain", T.redact(T.normalize_text(F.col("text_feedback")))).collect()
    assert all(r["text_processed"] == r["plain"] for r in out)
    assert [(r["char_count"], r["word_count"], r["sentence_count"]) for r in out[1:3]] == [(0, 0, 0), (0, 0, 0)]
    assert (out[3]["word_count"], out[3]["sentence_count"], out[3]["avg_word_length"]) == (3, 2, 3.67)


def test_stateless_cleaning_accepts_a_stream(spark, tmp_path):
    spark.createDataFrame([("a  b",)], "text_feedback string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text_feedback string").parquet(str(tmp_path / "in"))
    assert T.preprocess(stream).isStreaming


def test_tokens_and_ngrams(spark):
    frame = spark.createDataFrame([("«Очень» хорошо, e-mail!",)], "t string").select(word_tokens(F.col("t")).alias("w"))
    assert frame.first()["w"] == ["очень", "хорошо", "e-mail"]
    assert frame.select(word_ngrams(F.col("w")).alias("g")).first()["g"] == [
        "очень", "хорошо", "e-mail", "очень хорошо", "хорошо e-mail",
    ]
    grams = one(spark, "ab", lambda c: padded_char_ngrams(padded(c)))
    assert grams == [" a", "ab", "b ", " ab", "ab ", " ab "]


def test_numbers(spark):
    assert [one(spark, v, to_number) for v in (" 7 ", "x", "NaN", "", None, "1e3")] == [7.0, None, None, None, None, 1000.0]


def test_spelled_out_classes_are_complements(spark):
    chars = spark.createDataFrame([(chr(i),) for i in [*range(0x3100), 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x10FFFF]], "c string")
    assert chars.where(F.col("c").rlike(f"^[{T.NOT_BLANK}]") == F.col("c").rlike(f"^[{T.BLANK}]")).count() == 0
    stays = r"^[^\x{0}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{2010}-\x{2027}]"
    assert "^" not in T._NFC_MAY_CHANGE and chars.where(F.col("c").rlike(stays) != F.col("c").rlike(f"^{T._NFC_MAY_CHANGE}")).count() == 0
