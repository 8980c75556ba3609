"""The words of a paragraph are split once where the plan filters on the classes."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from kinfold.llm import licences


def test_filter_splits_words_once(spark):
    rows = spark.createDataFrame([("Licensed under the MIT License.",), ("cats and dogs",), ("dogs",), ("",), (None,)], "para string").withColumn("w", licences.words(F.col("para")))
    got = [r.g for r in rows.select(licences.grams(F.col("w")).alias("g")).collect()]
    assert got[1:] == [["cats", "and", "dogs", "cats and", "and dogs", "dogs $"], ["dogs", "dogs $"], [], None]
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=64, binary=True)
    labelled = hashing.transform(rows.where("w IS NOT NULL").withColumn("grams", licences.grams(F.col("w"))).withColumn("label", F.size("w") % 2 * 1.0))
    scanner = licences.Scanner(hashing, LogisticRegression(family="multinomial", maxIter=2).fit(labelled), ["a", "b"], 0.5)
    found = scanner.probabilities(rows).where(F.element_at("p", 1) < 0.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "element_at" in line]
    assert filters and all(line.count("split(") <= 1 for line in filters)
