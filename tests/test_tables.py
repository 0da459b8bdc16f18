import pytest
from pyspark.sql import functions as F

from surveyloom.operators import align, predicates as P, schema as S
from surveyloom.sources import files


def test_roles_follow_override_store_name_alias(spark):
    frame = spark.createDataFrame([("t", "good", "short")], "free_text string, tone_label string, length string")
    stored = {"free_text": "text", "tone_label": "sentiment"}
    found = S.resolve_roles(frame, stored)
    assert found.text == "free_text" and found.labels == {"sentiment": "tone_label", "detail_level": "length"}
    assert S.resolve_roles(frame, stored, {"text": "length"}).text == "length"
    assert S.standardize(frame, stored).columns == ["text_feedback", "sentiment_class", "detail_level"]
    twice = spark.createDataFrame([("a", "b")], "text string, feedback string")
    assert S.standardize(twice).columns == ["text", "feedback"]
    padded = spark.createDataFrame([("a", 1)], ["  comment ", "n"])
    assert S.standardize(padded).columns == ["text_feedback", "n"]
    assert S.infer_roles(padded) == {"  comment ": "text"}


def test_rename_guards(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        S.rename_columns(frame, {"x": "y"})
    with pytest.raises(ValueError):
        S.rename_columns(frame, {"a": "b"})


@pytest.fixture()
def rules_frame(spark):
    rows = [("ru", "Positive", "0.9", "Good course"), ("kz", "negative", "0.4", "Bad"), ("ru", "neutral", "x", None), ("RU", "positive", "nan", "100% a.b")]
    return spark.createDataFrame(rows, "language string, sentiment string, score string, text string")


def test_rule_operators(rules_frame):
    def n(*rules, **kw):
        return P.filter_rows(rules_frame, [dict(zip(("col", "op", "val"), r, strict=True)) for r in rules], **kw).count()

    assert n(("language", "eq", "RU")) == 3
    assert n(("language", "ne", "ru")) == 1
    assert n(("text", "contains", "a.b")) == 1
    assert n(("text", "contains", "a,b")) == 0
    assert n(("score", "gt", "0.4")) == 1
    assert n(("score", "gte", "0.4")) == 2
    assert n(("score", "lt", "0.9"), ("language", "eq", "kz")) == 1
    assert n(("score", "lt", "abc")) == 4
    assert n(("nowhere", "eq", "x")) == 4
    assert n(column="language", value="kz") == 1
    assert n(search="GOOD") == 1


def test_edits_append_delete(spark):
    base = spark.createDataFrame([(i, f"n{i}", str(i)) for i in range(5)], "row_idx bigint, name string, score string")
    edits = spark.createDataFrame([(1, "name", "a", 1), (1, "name", "b", 2), (2, "score", None, 1)], "row_idx bigint, col string, value string, seq int")
    done = {r["row_idx"]: r for r in align.apply_edits(base, edits).collect()}
    assert done[1]["name"] == "b" and done[2]["score"] is None and done[0]["name"] == "n0"
    with pytest.raises(ValueError):
        align.apply_edits(base, edits.withColumn("row_idx", F.lit(99).cast("bigint")), strict=True)
    longer = align.append_rows(base, spark.createDataFrame([(0, "new", 5)], "row_idx bigint, name string, other int"), "row_idx")
    assert longer.orderBy("row_idx").collect()[-1].asDict() == {"row_idx": 5, "name": "new", "score": ""}
    fewer = align.delete_rows(longer, spark.createDataFrame([(0,), (3,)], "row_idx bigint"), strict=True)
    assert [(r["row_idx"], r["name"]) for r in fewer.orderBy("row_idx").collect()] == [(0, "n1"), (1, "n2"), (2, "n4"), (3, "new")]
    with pytest.raises(ValueError):
        align.delete_rows(base, base.select("row_idx"), strict=True)


def test_csv_checks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,"text\n",x\n1,"a ""quoted""\nline",NA\n,,\n')
    frame = files.read_strings(spark, path)
    assert [c.strip() for c in frame.columns] == ["id", "text", "x"]
    rows = frame.collect()
    assert rows[0][1] == 'a "quoted"\nline' and rows[0][2] is None
    assert files.check_structure(frame).first()["n_empty_rows"] == 1
    with pytest.raises(ValueError):
        files.empty_table(spark, ["a", "a"])
    with pytest.raises(ValueError):
        files.validate_survey(spark.createDataFrame([(1, 11)], "survey_id int, item_1 int"), strict=True)


def test_trainable_rows_need_two_classes(spark):
    rows = [("a",)] * 6 + [("b ",)] * 5 + [("c",)] * 2 + [(" ",), (None,)]
    frame = spark.createDataFrame(rows, "label string")
    assert {r["label"] for r in P.trainable_rows(frame, "label", strict=True).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        P.trainable_rows(frame.where("label = 'a'"), "label", strict=True)
