"""A trained alternative to the deal rule: will the price drop within the horizon?"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("to_list", "to_low", "to_median", "percentile", "sale_share", "sale_windows_n", "since_sale")


def features(rollups: DataFrame, windows: Column, min_observations: int = 30) -> DataFrame:
    """Rollups with the seven features; rows without a price in stock, or with too thin a year, are left out."""
    price = F.col("current_price_cents").cast("double")
    since = F.floor((F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("last_sale_ended_at").cast("timestamp"))) / 86_400)
    found = {
        "to_list": price / F.col("list_price_cents"),
        "to_low": price / F.col("min_365d"),
        "to_median": price / F.col("median_365d"),
        "percentile": F.col("percentile_365d"),
        "sale_share": F.col("sale_days_365d") / 365.0,
        "sale_windows_n": windows.cast("double"),
        "since_sale": F.coalesce(F.least(F.lit(365), F.greatest(F.lit(0), since)), F.lit(365)) / 365.0,
    }
    usable = price.isNotNull() & F.col("current_in_stock") & (F.col("observations_365d") >= min_observations) & F.col("list_price_cents").isNotNull() & F.col("percentile_365d").isNotNull()
    return rollups.where(usable).withColumns(found)


def train(examples: DataFrame, label: str = "dropped", steps: int = 200, decay: float = 0.001):
    """Logistic regression on standardised features; returns a function that adds the probability of a drop."""
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="__raw")
    rows = assemble.transform(examples.withColumn("__label", F.col(label).cast("double")))
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(rows)
    fit = LogisticRegression(featuresCol="__x", labelCol="__label", maxIter=steps, regParam=decay, standardization=False, probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r")
    model: LogisticRegressionModel = fit.fit(scale.transform(rows))

    def probability(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        done = model.transform(scale.transform(assemble.transform(df)))
        return done.withColumn("probability", vector_to_array("__p")[1]).drop("__raw", "__x", "__r", "__p", "__c")

    return probability


def call(probability: Column, buy_below: float, wait_above: float) -> Column:
    return F.when(probability < buy_below, "buy").when(probability > wait_above, "wait").otherwise("neutral")


def chronological(examples: DataFrame, day: str, cut: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Training days whose horizon ends before ``cut``, and the days from ``cut`` on."""
    return examples.where(F.col(day) + horizon < cut), examples.where(F.col(day) >= cut)
