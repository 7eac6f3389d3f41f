"""The test tables seen as products, offers, observations, mentions and tasks; in Spark and, with the same names, in SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prices import insert_absent
from tidemark.operators.sinks import read_observations, write_observations
from tidemark.session import shared_dir

AS_OF = datetime(2001, 6, 30)
AS_OF_SQL = "timestamp '2001-06-30 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is an observation of the offer (brand, supplier); its price is a ladder of whole cents."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("product_id"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    price = F.expr("(5000 + 100 * (l_suppkey % 40)) * (100 - cast(round(l_discount * 100) as int)) div 100").cast("int")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("product_id") * 1_000_000 + F.col("l_suppkey")).alias("offer_id"),
        F.col("l_shipdate").alias("observed_at"),
        price.alias("price_cents"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        (F.col("l_linestatus") == "O").alias("synthetic"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("line"),
    )


#: Where each application has stored the facts of a folder of test tables.
_STORED: dict[tuple[str, str], str] = {}
#: Observations of a month that one task writes, about.
MONTH_ROWS = 5_000_000


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the fact table, by month and offer, and of the offers: the bulk load that queries run on, once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/tidemark/{key[0]}/model-{uuid.uuid4().hex}"
        raw = raw_observations(spark, sf_dir)
        write_observations(insert_absent(raw, ["run_id", "line"]), f"{path}/observations", 1 + raw.count() // (80 * MONTH_ROWS))
        _offers(raw).write.parquet(f"{path}/offers")
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(files)
        _STORED[key] = path
    return _STORED[key]


def observations(spark: SparkSession, sf_dir: str, after: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return read_observations(spark, f"{stored(spark, sf_dir)}/observations", after, until).drop("obs_month")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{stored(spark, sf_dir)}/offers")


def _offers(raw: DataFrame) -> DataFrame:
    own = raw.select("offer_id").distinct()
    supplier = F.col("offer_id") % 1_000_000
    return own.select(
        "offer_id",
        F.floor(F.col("offer_id") / 1_000_000).cast("long").alias("product_id"),
        F.when(supplier % 7 == 0, "pending").otherwise("auto").alias("status"),
        (supplier % 10 == 0).alias("retired"),
        F.concat(F.lit("retailer "), (supplier % 5).cast("string")).alias("retailer"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return read(spark, sf_dir, "part").select(number.alias("product_id"), F.col("p_brand").alias("name")).distinct()


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as products: the day's least value of an event that is no error, in cents."""
    from tidemark.operators.backtest import spine

    event = read(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day_idx")
    cents = F.round(F.col("value") * 100).cast("int")
    daily = event.groupBy(F.col("user_id").alias("product_id"), day).agg(F.min(F.when(F.col("event_type") != "error", cents)).alias("price_cents"))
    last = daily.agg(F.max("day_idx")).first()[0]
    return spine(daily, 1 + (last or 0)).withColumn("in_stock", F.col("price_cents").isNotNull())


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mentions, with products, sentiments and times that follow from their ids."""
    doc = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        doc.alias("mention_id"),
        (doc % 25 + 1).alias("product_id"),
        F.col("lang").alias("community"),
        F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.5).when(F.col("lang") == "fr", 2.0).alias("weight"),
        F.when(doc % 7 < 3, "positive").when(doc % 7 < 5, "negative").otherwise("neutral").alias("sentiment"),
        F.when(doc % 11 == 0, "reviewed").otherwise("auto").alias("status"),
        F.timestamp_seconds(F.lit(993_859_200) - doc % 120 * 86_400).alias("posted_at"),
    )


#: Common table expressions of the same relations for the SQL side.
SQL = {
    "raw_observations": """select cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) * 1000000 + l_suppkey as offer_id, l_shipdate as observed_at,
      cast((5000 + 100 * (l_suppkey % 40)) * (100 - cast(round(l_discount * 100) as int)) // 100 as int) as price_cents,
      l_returnflag <> 'R' as in_stock, l_linestatus = 'O' as synthetic, l_orderkey as run_id, l_linenumber as line
      from lineitem join part on l_partkey = p_partkey""",
    "observations": "select * exclude (rn) from (select *, row_number() over (partition by offer_id, observed_at order by run_id, line) as rn from raw_observations) where rn = 1",
    "offers": """select offer_id, offer_id // 1000000 as product_id, case when offer_id % 1000000 % 7 = 0 then 'pending' else 'auto' end as status,
      offer_id % 1000000 % 10 = 0 as retired, 'retailer ' || cast(offer_id % 1000000 % 5 as varchar) as retailer from (select distinct offer_id from raw_observations)""",
    "products": "select distinct cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) as product_id, p_brand as name from part",
    "linked": "select offer_id, product_id from offers where status in ('auto', 'reviewed') and not retired",
    "year": f"select * from observations where observed_at > {AS_OF_SQL} - interval 365 day and observed_at <= {AS_OF_SQL}",
    "series": """select product_id as key, observed_at, min(price_cents) as price_cents, true as in_stock, bool_or(synthetic) as synthetic
      from year join linked using (offer_id) where in_stock group by product_id, observed_at""",
    "offer_series": "select offer_id as key, observed_at, price_cents, in_stock, synthetic from year",
    "newest": "select distinct on (offer_id) offer_id, observed_at, price_cents, in_stock from year order by offer_id, observed_at desc",
    "current": """select distinct on (product_id) product_id as key, price_cents, observed_at, in_stock, offer_id from newest join linked using (offer_id)
      order by product_id, in_stock desc, price_cents, observed_at desc, offer_id""",
    "offer_current": "select offer_id as key, price_cents, observed_at, in_stock, cast(null as bigint) as offer_id from newest",
    "daily": """select user_id as product_id, date_diff('day', date '2024-01-01', cast(ts as date)) as day_idx,
      min(case when event_type <> 'error' then cast(round(value * 100) as int) end) as price_cents from events group by 1, 2""",
    "grid": """select p.product_id, d.day_idx, y.price_cents, y.price_cents is not null as in_stock
      from (select distinct product_id from daily) p cross join (select unnest(range((select max(day_idx) + 1 from daily))) as day_idx) d
      left join daily y on y.product_id = p.product_id and y.day_idx = d.day_idx""",
    "mentions": """select doc_id as mention_id, doc_id % 25 + 1 as product_id, lang as community,
      case lang when 'en' then 1.0 when 'de' then 0.5 when 'fr' then 2.0 end as weight,
      case when doc_id % 7 < 3 then 'positive' when doc_id % 7 < 5 then 'negative' else 'neutral' end as sentiment,
      case when doc_id % 11 = 0 then 'reviewed' else 'auto' end as status,
      timestamp '2001-06-30 00:00:00' - (doc_id % 120) * interval 1 day as posted_at from documents""",
}
_NEEDS = {
    "observations": ["raw_observations"], "offers": ["raw_observations"], "linked": ["offers"], "year": ["observations"],
    "series": ["year", "linked"], "offer_series": ["year"], "newest": ["year"], "current": ["newest", "linked"], "offer_current": ["newest"], "grid": ["daily"],
}


def with_(*names: str, **more: str) -> str:
    """A WITH clause of the named relations and what they need, then of ``more``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join([*(f"{n} as ({SQL[n]})" for n in order), *(f"{n} as ({q})" for n, q in more.items())]) + "\n"
