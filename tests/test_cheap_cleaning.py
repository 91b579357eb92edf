"""Plain texts are cleaned without trimming, lower-casing or searching them."""

from earshot.functions.text import clean_text, with_clean_text
from pyspark.sql import functions as F

ODD = ["  a ", "nan", "NaN ", "None", "null", "nulls", "", "   ", "　x　", "a ", "Ã©tÃ©", "é", "\x7f", "\x1fq", "!", "~", "KK",
       "\tz\n", " !", "â€™s", "�", "x� ", "NONE", "\U0001f600 ", "Naïve", None]


def test_plain_texts_skip_the_trimming(spark):
    df = spark.createDataFrame([(v,) for v in ODD], "v string")
    cleaned = with_clean_text(df, {"v": F.col("v")})
    assert [r[0] for r in cleaned.collect()] == [r[0] for r in df.select(clean_text("v")).collect()]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan[plan.rindex("Project ["):] and "octet_length" in plan
