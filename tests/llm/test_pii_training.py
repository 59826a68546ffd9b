import pytest
from pyspark.sql import functions as F

from pagelens.llm import pii


class Seen(Exception):
    pass


def test_every_candidate_trains_or_calibrates(spark, monkeypatch):
    """More candidates than any fixed number of them that training once took."""
    number = F.concat(F.lit("call +1 555 "), (F.col("id") % 900 + 100).cast("string"), F.lit(" 4567, part 12345678"), F.lit(" then "))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(number, 60).alias("text"))
    used = []

    def model(train):
        used.append(train.count())
        raise Seen

    monkeypatch.setattr(pii, "_model", model)
    with pytest.raises(Seen):
        pii.personal_data(docs)
    assert used[0] > 20_000
