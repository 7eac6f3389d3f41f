"""The registered queries: key, DataFrame form, SQL form. Keys begin with the ids of the operator inventory."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest, community, prices, signals
from tidemark.plans import model
from tidemark.plans.model import AS_OF, AS_OF_SQL, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def _year(s: SparkSession, d: str) -> DataFrame:
    """The year's months only."""
    return model.observations(s, d, AS_OF - timedelta(days=365), AS_OF)


def _series(s, d):
    return prices.product_series(_year(s, d), model.offers(s, d))


def _current(s, d):
    return prices.current_products(_year(s, d), model.offers(s, d))


_LIST = "select key, price_cents as list_price_cents from (select key, price_cents, row_number() over (partition by key order by count(*) desc, price_cents desc) as rn from series group by key, price_cents) where rn = 1"
_SALES = """select key, min(observed_at) as start_at, max(observed_at) as end_at, min(price_cents) as min_price_cents,
  cast(round(100 * (1 - cast(min(price_cents) as decimal(20,10)) / max(list_price_cents))) as int) as off_pct, count(distinct cast(observed_at as date)) as days
  from (select *, sum(begins) over (partition by key order by observed_at) as sale_no from (
    select *, case when sale and not coalesce(lag(sale) over (partition by key order by observed_at), false) then 1 else 0 end as begins from (
      select s.*, l.list_price_cents, s.price_cents * 10 <= l.list_price_cents * 9 as sale from series s join listp l using (key))))
  where sale group by key, sale_no"""
_TOTALS = "select key, cast(sum(days) as bigint) as sale_days_365d, max(end_at) as last_sale_ended_at, count(*) as sale_count, max(off_pct) as deepest_pct from sales group by key"


def _inside(days: int) -> str:
    return "" if days == 365 else f" filter (where s.observed_at > {AS_OF_SQL} - interval {days} day)"


_MEASURES = (
    "select s.key, "
    + ", ".join(f"min(s.price_cents){_inside(n)} as min_{n}d, cast(round_even(quantile_cont(s.price_cents, 0.5){_inside(n)}, 0) as int) as median_{n}d, max(s.price_cents){_inside(n)} as max_{n}d" for n in prices.WINDOWS)
    + """, case when max(c.price_cents) is not null then cast(count(*) filter (where s.price_cents < c.price_cents) as double) / count(*) end as percentile_365d,
  round(stddev_samp(s.price_cents) / nullif(avg(s.price_cents), 0), 9) as volatility_365d, count(*) as observations_365d, count(*) filter (where s.synthetic) as synthetic_365d
  from series s left join current c on c.key = s.key group by s.key"""
)
_ROLLUP = """select k.key, c.price_cents as current_price_cents, c.observed_at as current_observed_at, c.in_stock as current_in_stock, c.offer_id as current_offer_id,
  l.list_price_cents, m.* exclude (key, observations_365d, synthetic_365d), coalesce(m.observations_365d, 0) as observations_365d, coalesce(m.synthetic_365d, 0) as synthetic_365d,
  coalesce(t.sale_days_365d, 0) as sale_days_365d, t.last_sale_ended_at, coalesce(t.sale_count, 0) as sale_count
  from keys k left join current c on c.key = k.key left join listp l on l.key = k.key left join measures m on m.key = k.key left join totals t on t.key = k.key"""
_CHAIN = {"listp": _LIST, "sales": _SALES, "totals": _TOTALS, "measures": _MEASURES}
_PRODUCT = {"keys": "select product_id as key from products", **_CHAIN, "rollups": _ROLLUP}
_OFFER = {"keys": "select offer_id as key from offers", **{k: v.replace("series", "offer_series").replace("join current", "join offer_current") for k, v in _CHAIN.items()}, "rollups": _ROLLUP.replace("left join current", "left join offer_current")}


def _flat(rollups: DataFrame) -> DataFrame:
    return rollups.withColumn("sale_count", F.size("sale_windows").cast("long")).withColumn("volatility_365d", F.round("volatility_365d", 9)).drop("sale_windows", "as_of")


def product_rollups(s, d):
    keys = model.products(s, d).select(F.col("product_id").alias("key"))
    return _flat(prices.rollup_products(_year(s, d), model.offers(s, d), keys, AS_OF))


def offer_rollups(s, d):
    keys = model.offers(s, d).select(F.col("offer_id").alias("key"))
    return _flat(prices.rollup_offers(_year(s, d), keys, AS_OF))


query("D02_product_rollup", with_("products", "series", "current", **_PRODUCT) + "select * from rollups")(product_rollups)
query("D01_offer_rollup", with_("offers", "offer_series", "offer_current", **_OFFER) + "select * from rollups")(offer_rollups)


@query(
    "A27_deal_query_raw",
    with_("products", "series", "newest", "linked")
    + """, cheapest as (select product_id as key, min(price_cents) as current_price_cents from newest join linked using (offer_id) where in_stock group by product_id),
    ranked as (select s.key, cast(count(*) filter (where s.price_cents < c.current_price_cents) as double) / count(*) as percentile_365d, min(s.price_cents) as min_365d, quantile_cont(s.price_cents, 0.5) as median_365d
      from series s join cheapest c using (key) group by s.key)
    select p.product_id, p.name, c.current_price_cents, r.percentile_365d, r.min_365d, r.median_365d from products p join cheapest c on c.key = p.product_id join ranked r on r.key = p.product_id
    where c.current_price_cents between 4000 and 4800 order by percentile_365d, current_price_cents, product_id limit 20""",
)
def deal_query_raw(s: SparkSession, d: str) -> DataFrame:
    """Products in stock within a price range, cheapest against their own year first."""
    year = _year(s, d)
    linked = model.offers(s, d).where(prices.live()).select("offer_id", F.col("product_id").alias("key"))
    newest = F.max_by("price_cents", F.when(F.col("in_stock"), F.col("observed_at"))), F.max(F.when(F.col("in_stock"), F.col("observed_at"))), F.max("observed_at")
    each = year.groupBy("offer_id").agg(newest[0].alias("price_cents"), newest[1].alias("seen"), newest[2].alias("last"))
    cheapest = each.where("seen = last").join(linked, "offer_id").groupBy("key").agg(F.min("price_cents").alias("current_price_cents")).where(F.col("current_price_cents").between(4000, 4800))
    series = prices.product_series(year, model.offers(s, d)).join(cheapest, "key")
    ranked = series.groupBy("key", "current_price_cents").agg(
        (F.count_if(F.col("price_cents") < F.col("current_price_cents")) / F.count("*")).alias("percentile_365d"), F.min("price_cents").alias("min_365d"), F.expr("percentile_cont(0.5) within group (order by price_cents)").alias("median_365d")
    )
    rows = ranked.withColumnRenamed("key", "product_id").join(model.products(s, d), "product_id")
    return rows.orderBy("percentile_365d", "current_price_cents", "product_id").limit(20).select("product_id", "name", "current_price_cents", "percentile_365d", "min_365d", "median_365d")


query("A01_product_series", with_("series") + "select * from series")(_series)
query("W05_current_per_product", with_("current") + "select * from current")(_current)
query("W05_latest_per_offer", with_("newest") + "select * from newest")(lambda s, d: prices.latest(_year(s, d)))
query("A02_list_price_mode", with_("series", listp=_LIST) + "select * from listp")(lambda s, d: prices.list_price(_series(s, d)))
query("W02_W03_A08_sale_windows", with_("series", listp=_LIST, sales=_SALES) + "select * from sales")(lambda s, d: prices.sales(_series(s, d), prices.list_price(_series(s, d))))


@query("A10_sale_totals", with_("series", listp=_LIST, sales=_SALES, totals=_TOTALS) + "select * from totals")
def sale_totals(s, d):
    totals = prices.sale_totals(prices.sales(_series(s, d), prices.list_price(_series(s, d))))
    deepest = F.array_max(F.transform("sale_windows", lambda w: w["off_pct"]))
    return totals.select("key", "sale_days_365d", "last_sale_ended_at", F.size("sale_windows").cast("long").alias("sale_count"), deepest.alias("deepest_pct"))


@query("A03_A07_window_measures", with_("series", "current", measures=_MEASURES) + "select * from measures")
def measures(s, d):
    return prices.measures(_series(s, d), _current(s, d), AS_OF).withColumn("volatility_365d", F.round("volatility_365d", 9))


_SIGNAL = """select key, case when gate is not null then 'neutral' when buy then 'buy' when wait then 'wait' else 'neutral' end as signal,
  case when gate is not null then gate else concat_ws(',', case when sale then 'ON_SALE' when at_list then 'AT_LIST' else 'MILD_DISCOUNT' end,
    case when low then 'YEAR_LOW' when near then 'NEAR_YEAR_LOW' end, case when cheap then 'LOW_PERCENTILE' when dear then 'HIGH_PERCENTILE' end,
    case when buy then null when wait then 'SALES_RECUR' when not ever then 'NO_SALE_HISTORY' when recur then 'MIDDLING_SALE' else 'SALES_RARE' end,
    case when synthetic_365d * 2 > observations_365d then 'MOSTLY_SYNTHETIC' end) end as reason_codes
  from (select *, sale and (low or near or cheap) as buy, not (sale and (low or near or cheap)) and recur and (not sale or dear) as wait from (
    select key, synthetic_365d, observations_365d, current_price_cents * 10 <= list_price_cents * 9 as sale, current_price_cents >= list_price_cents as at_list, current_price_cents <= min_365d as low,
      current_price_cents > min_365d and current_price_cents <= min_365d * 1.05::double as near, percentile_365d <= 0.2 as cheap, percentile_365d >= 0.5 as dear,
      sale_days_365d > 0 as ever, sale_days_365d > 0 and sale_count >= 1 as recur,
      case when current_price_cents is null then 'NO_PRICE' when not coalesce(current_in_stock, false) then 'OUT_OF_STOCK' when observations_365d < 30 then 'THIN_HISTORY' end as gate from rollups))"""


def deal_signals(s, d):
    return signals.decide(product_rollups(s, d), windows=F.col("sale_count"))


@query("D05_deal_signal", with_("products", "series", "current", **_PRODUCT) + _SIGNAL)
def signal_rows(s, d):
    return deal_signals(s, d).select("key", "signal", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("D05_offer_signal", with_("offers", "offer_series", "offer_current", **_OFFER) + _SIGNAL)
def offer_signals(s, d):
    """The rule on every offer's own rollup: exercises the gates."""
    return signals.decide(offer_rollups(s, d), windows=F.col("sale_count")).select("key", "signal", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("D33_offer_history", with_("observations") + "select * from observations where offer_id = 1000001")
def offer_history(s, d):
    """The bound reaches the scan, whose files are clustered by offer."""
    return model.observations(s, d).where("offer_id = 1000001")


@query("D33_offer_window_90d", with_("observations") + f"select * from observations where offer_id = 1000001 and observed_at > {AS_OF_SQL} - interval 90 day and observed_at <= {AS_OF_SQL}")
def offer_window(s, d):
    return model.observations(s, d, AS_OF - timedelta(days=90), AS_OF).where("offer_id = 1000001")


@query(
    "A11_daily_history",
    with_("observations") + "select offer_id, cast(observed_at as date) as day, min(price_cents) filter (where in_stock) as min_price_cents, bool_or(synthetic) as synthetic, count(*) as observations from observations group by 1, 2",
)
def daily_history(s, d):
    return prices.daily_history(model.observations(s, d))


@query(
    "A14_span",
    with_("observations", "linked")
    + "select min(observed_at) as first_at, max(observed_at) as last_at, min(observed_at) filter (where not synthetic) as first_observed, max(observed_at) filter (where not synthetic) as last_observed from observations join linked using (offer_id)",
)
def span(s, d):
    rows = model.observations(s, d).join(model.offers(s, d).where(prices.live()).select("offer_id"), "offer_id", "left_semi")
    real = F.when(~F.col("synthetic"), F.col("observed_at"))
    return rows.agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.min(real).alias("first_observed"), F.max(real).alias("last_observed"))


@query(
    "A15_state_counts_zero_filled",
    "select s.state, coalesce(n, 0) as n from (values ('O'), ('F'), ('P'), ('X')) s(state) left join (select o_orderstatus as state, count(*) as n from orders group by 1) c on c.state = s.state",
)
def state_counts(s, d):
    states = s.createDataFrame([(x,) for x in "OFPX"], "state string")
    return states.join(model.read(s, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "A12_close_runs",
    "select cast(o_orderdate as date) as run_day, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus = 'O') as queued, count(*) filter (where o_orderstatus = 'P') as dead, count(distinct o_custkey) as workers from orders group by 1 having count(*) filter (where o_orderstatus = 'O') = 0",
)
def close_runs(s, d):
    state = lambda x, n: F.count_if(F.col("o_orderstatus") == x).alias(n)
    runs = model.read(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("run_day")).agg(state("F", "done"), state("O", "queued"), state("P", "dead"), F.count_distinct("o_custkey").alias("workers"))
    return runs.where("queued = 0")


@query(
    "C04_reap_and_promote",
    "select o_orderkey as task_id, case when o_orderstatus = 'O' and o_orderdate < timestamp '1998-01-01' then case when cast(left(o_orderpriority, 1) as int) >= 3 then 'dead' else 'queued' end when o_orderstatus = 'P' and o_orderdate < timestamp '1999-01-01' then 'queued' else o_orderstatus end as state from orders",
)
def reap(s, d):
    c = F.col
    expired = (c("o_orderstatus") == "O") & (c("o_orderdate") < F.lit(datetime(1998, 1, 1)))
    due = (c("o_orderstatus") == "P") & (c("o_orderdate") < F.lit(datetime(1999, 1, 1)))
    spent = F.substring("o_orderpriority", 1, 1).cast("int") >= 3
    state = F.when(expired, F.when(spent, "dead").otherwise("queued")).when(due, "queued").otherwise(c("o_orderstatus"))
    return model.read(s, d, "orders").select(c("o_orderkey").alias("task_id"), state.alias("state"))


@query(
    "O12_claim_order",
    "select o_custkey as domain, min_by(o_orderkey, (o_orderdate, o_orderkey)) as task_id from orders where o_orderstatus = 'O' group by 1",
)
def claim_order(s, d):
    """The task that each domain would give next."""
    return model.read(s, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("domain")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("task_id"))


@query("A26_summary_with_total", with_("offers") + "select coalesce(retailer, 'TOTAL') as retailer, count(*) as offers, count(*) filter (where retired) as retired, count(*) filter (where status = 'pending') as pending from offers group by rollup (retailer)")
def summary(s, d):
    rows = model.offers(s, d).rollup("retailer").agg(F.count("*").alias("offers"), F.count_if("retired").alias("retired"), F.count_if(F.col("status") == "pending").alias("pending"))
    return rows.withColumn("retailer", F.coalesce("retailer", F.lit("TOTAL")))


@query(
    "A13_derived_spec",
    "select product_id, k, v, n from (select *, row_number() over (partition by product_id, k order by n desc, v) as rn from (select product_id, k, v, count(*) as n from (select cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) as product_id, 'type' as k, p_type as v from part union all select cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint), 'size', cast(p_size as varchar) from part) group by 1, 2, 3)) where rn = 1",
)
def derived_spec(s, d):
    """Each product's most common value of every spec field; ties to the lesser text."""
    part = model.read(s, d, "part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("product_id"), F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("spec"))
    counted = part.select("product_id", F.explode("spec").alias("k", "v")).groupBy("product_id", "k", "v").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")
    return counted.groupBy("product_id", "k").agg(best).select("product_id", "k", F.col("b.v").alias("v"), (-F.col("b.m")).alias("n"))


@query("J08_semi_live_offers", with_("observations", "linked") + "select offer_id, observed_at, price_cents from observations where offer_id in (select offer_id from linked)")
def semi(s, d):
    return model.observations(s, d).join(model.offers(s, d).where(prices.live()), "offer_id", "left_semi").select("offer_id", "observed_at", "price_cents")


@query(
    "J09_anti_without_synthetic",
    with_("observations") + "select distinct on (offer_id) offer_id, price_cents as anchor_cents, observed_at from observations o where not exists (select 1 from observations x where x.offer_id = o.offer_id and x.synthetic and x.in_stock and x.price_cents < 4600) order by offer_id, observed_at",
)
def anti(s, d):
    """Offers that some kind of row is missing for, with their first price."""
    rows = model.observations(s, d)
    other = rows.where("synthetic and in_stock and price_cents < 4600").select("offer_id")
    return rows.join(other, "offer_id", "left_anti").groupBy("offer_id").agg(F.min_by("price_cents", "observed_at").alias("anchor_cents"), F.min("observed_at").alias("observed_at"))


@query("J20_comment_parent", "select c.conv_id, c.turn, c.role, p.role as parent_role, length(p.text) as parent_length from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = 0 where c.turn > 0")
def comment_parent(s, d):
    rows = model.read(s, d, "conversations")
    post = rows.where("turn = 0").select("conv_id", F.col("role").alias("parent_role"), F.char_length("text").cast("long").alias("parent_length"))
    return rows.where("turn > 0").join(post, "conv_id").select("conv_id", "turn", "role", "parent_role", "parent_length")


@query("K03_insert_absent", with_("observations") + "select * from observations")
def absent(s, d):
    return prices.insert_absent(model.raw_observations(s, d), ["run_id", "line"])


@query(
    "K05_upsert_counts",
    "select case when o.doc_id is null then 'inserted' else 'refreshed' end as outcome, count(*) as n from (select doc_id from documents) n left join (select doc_id from labels group by 1) o using (doc_id) group by 1",
)
def upsert_counts(s, d):
    docs = model.read(s, d, "documents").select("doc_id")
    old = model.read(s, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return docs.join(old, "doc_id", "left").groupBy(F.when(F.col("known").isNull(), "inserted").otherwise("refreshed").alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "K08_replace_machine_rows",
    with_("mentions") + "select mention_id, product_id, sentiment, status from mentions where status = 'reviewed' union all select mention_id, product_id, 'neutral', 'auto' from mentions where community in ('de', 'en') and mention_id not in (select mention_id from mentions where status = 'reviewed')",
)
def replace_machine_rows(s, d):
    from tidemark.operators.sinks import replace_machine_rows as replace

    rows = model.mentions(s, d).select("mention_id", "product_id", "sentiment", "status")
    made = model.mentions(s, d).where("community in ('de', 'en')").select(*rows.columns).withColumn("sentiment", F.lit("neutral")).withColumn("status", F.lit("auto"))
    return replace(rows, made, ["mention_id", "product_id"])


@query("K15_retention", with_("mentions") + f"select mention_id, posted_at from mentions where posted_at >= {AS_OF_SQL} - interval 30 day or community = 'de'")
def retention(s, d):
    from tidemark.operators.sinks import retain

    return retain(model.mentions(s, d), "posted_at", AS_OF - timedelta(days=30), F.col("community") != "de").select("mention_id", "posted_at")


@query(
    "D03_retire_unseen",
    with_("raw_observations", "offers")
    + """, seen as (select offer_id, max(observed_at) as last_seen from raw_observations group by 1), cut as (select min(started_at) as cutoff from (select o_orderdate as started_at from (select distinct o_orderdate from orders where o_orderstatus <> 'P') order by 1 desc limit 40))
    select offer_id, last_seen, retired or last_seen < cutoff as retired from offers join seen using (offer_id) cross join cut""",
)
def retire(s, d):
    seen = model.raw_observations(s, d).groupBy("offer_id").agg(F.max("observed_at").alias("last_seen"))
    runs = model.read(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderdate").alias("started_at")).distinct().select("started_at", F.lit(True).alias("finished"), F.lit("crawl").alias("kind"))
    return prices.retire_unseen(model.offers(s, d).join(seen, "offer_id"), runs, 40).select("offer_id", "last_seen", "retired")


@query("O04_nth_recent_run", "select o_orderdate as started_at from (select distinct o_orderdate from orders where o_orderstatus = 'F') order by 1 desc limit 1 offset 2")
def nth_run(s, d):
    return model.read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderdate").alias("started_at")).distinct().orderBy(F.desc("started_at")).offset(2).limit(1)


@query("U01_union_touched", with_("observations", "offers") + "select offer_id from observations where not in_stock union select offer_id from offers where retired")
def touched(s, d):
    return model.observations(s, d).where("not in_stock").select("offer_id").union(model.offers(s, d).where("retired").select("offer_id")).distinct()


@query("U03_intersection", with_("observations", "offers") + "select offer_id from observations where not in_stock intersect select offer_id from offers where retired")
def both(s, d):
    return model.observations(s, d).where("not in_stock").select("offer_id").intersect(model.offers(s, d).where("retired").select("offer_id"))


@query("U04_difference", with_("observations", "offers") + "select offer_id from offers except select offer_id from year_".replace("year_", "observations where not in_stock"))
def missing(s, d):
    return model.offers(s, d).select("offer_id").distinct().join(model.observations(s, d).where("not in_stock").select("offer_id"), "offer_id", "left_anti")


_CONSENSUS = """select p.product_id, c.score, case when c.score is null then 'unheard' when c.score >= 0.25 then 'liked' when c.score <= -0.25 then 'disliked' else 'mixed' end as leaning,
  coalesce(mention_count, 0) as mention_count, coalesce(positive_count, 0) as positive_count, coalesce(negative_count, 0) as negative_count, coalesce(neutral_count, 0) as neutral_count, coalesce(communities, 0) as communities, positive_share
  from products p left join (select product_id, round(coalesce(sum(w * s) / nullif(sum(w), 0), 0), 9) as score, count(*) as mention_count, count(*) filter (where s > 0) as positive_count, count(*) filter (where s < 0) as negative_count,
    count(*) filter (where s = 0) as neutral_count, count(distinct community) as communities, round(avg(case when s > 0 then 1.0 else 0.0 end), 9) as positive_share
    from (select *, cast(coalesce(weight, 1.0) as double) as w, case sentiment when 'positive' then 1 when 'negative' then -1 else 0 end as s from mentions where status = 'auto' and posted_at > timestamp '2001-06-30 00:00:00' - interval 90 day) group by 1) c using (product_id)"""


def _consensus(s, d):
    return community.consensus(model.products(s, d), model.mentions(s, d), AS_OF - timedelta(days=90))


@query("A17_consensus", with_("products", "mentions") + _CONSENSUS)
def consensus_rows(s, d):
    return _consensus(s, d).drop("quote_mention_ids").withColumn("score", F.round("score", 9)).withColumn("positive_share", F.round("positive_share", 9))


@query(
    "O09_J18_quote_pick",
    with_("mentions")
    + """, heard as (select *, row_number() over (partition by product_id, sentiment order by posted_at desc, mention_id) as own, row_number() over (partition by product_id order by posted_at desc, mention_id) as age
      from mentions where status = 'auto' and posted_at > timestamp '2001-06-30 00:00:00' - interval 90 day),
    ranked as (select *, row_number() over (partition by product_id order by case when own = 1 and sentiment = 'positive' then 0 when own = 1 and sentiment = 'negative' then 1 else 2 end, age) as pos from heard)
    select product_id, pos - 1 as pos, r.mention_id, length(text) as length from ranked r join documents on doc_id = mention_id where pos <= 2""",
)
def quotes(s, d):
    """The quotes of each product's consensus, fetched in their order."""
    picked = _consensus(s, d).select("product_id", F.posexplode("quote_mention_ids").alias("pos", "mention_id"))
    text = model.read(s, d, "documents").select(F.col("doc_id").alias("mention_id"), F.char_length("text").cast("long").alias("length"))
    return picked.join(text, "mention_id").select("product_id", F.col("pos").cast("long").alias("pos"), "mention_id", "length")


HORIZON, TOLERANCE, WARMUP = 3, 0.02, 5
_MEDIAN = "select *, median(price_cents) over (partition by product_id order by day_idx rows between 9 preceding and current row) as median_cents from grid"


def _ahead_sql(source: str, horizon: int, tolerance: float) -> str:
    return f"""select *, case when price_cents is not null and day_idx + {horizon} <= max(day_idx) over (partition by product_id) and least_ahead_cents is not null then least_ahead_cents < price_cents and price_cents - least_ahead_cents >= {tolerance}::double * price_cents end as dropped
      from (select *, min(price_cents) over (partition by product_id order by day_idx rows between 1 following and {horizon} following) as least_ahead_cents from {source})"""


_CALLS = "select g.*, s.strategy, case when s.strategy = 'always_buy' then 'buy' when median_cents is null then 'neutral' when price_cents < median_cents then 'buy' else 'wait' end as call from {0} g cross join (values ('always_buy'), ('below_median')) s(strategy)"
_GRID = {"medians": _MEDIAN, "futures": _ahead_sql("medians", HORIZON, TOLERANCE), "calls": _CALLS.format("futures")}
_TALLY = """count(*) as days, count(*) filter (where dropped) as drops, count(*) filter (where call = 'buy') as buys, count(*) filter (where call = 'wait') as waits, count(*) filter (where call not in ('buy', 'wait')) as neutrals,
  count(*) filter (where (call = 'buy' and not dropped) or (call = 'wait' and dropped)) as hits, count(*) filter (where call = 'buy' and not dropped) as buy_hits, count(*) filter (where call = 'wait' and dropped) as wait_hits"""
_RATES = """select *, cast(hits as double) / nullif(buys + waits, 0) as hit_rate, cast(buys + waits as double) / nullif(days, 0) as coverage, cast(buy_hits as double) / nullif(buys, 0) as buy_precision,
  cast(wait_hits as double) / nullif(waits, 0) as wait_precision, cast(drops as double) / nullif(days, 0) as base_rate from """
_SCORED = f"day_idx >= {WARMUP} and dropped is not null"


def _medians(s, d):
    return backtest.trailing_median(model.grid(s, d), 10)


def _futures(s, d, horizon=HORIZON, tolerance=TOLERANCE):
    return backtest.ahead(_medians(s, d), horizon, tolerance)


def _calls(s, d):
    return backtest.strategies(_futures(s, d))


query("W06_trailing_median", with_("grid", medians=_MEDIAN) + "select * from medians")(_medians)
query("W07_ahead", with_("grid", medians=_MEDIAN, futures=_GRID["futures"]) + "select * from futures")(_futures)
query("A18_D09_tally", with_("grid", **_GRID) + _RATES + f"(select strategy, {_TALLY} from calls where {_SCORED} group by 1)")(lambda s, d: backtest.tally(backtest.scored(_calls(s, d), WARMUP), ["strategy"]))
query("A21_tally_per_product", with_("grid", **_GRID) + _RATES + f"(select strategy, product_id, {_TALLY} from calls where {_SCORED} group by 1, 2)")(lambda s, d: backtest.tally(backtest.scored(_calls(s, d), WARMUP), ["strategy", "product_id"]))


@query(
    "A22_horizon_tolerance_sweep",
    with_("grid", medians=_MEDIAN)
    + _RATES
    + "("
    + " union all ".join(f"select {h} as horizon, {t}::double as tolerance, strategy, {_TALLY} from ({_CALLS.format('(' + _ahead_sql('medians', h, t) + ')')}) where {_SCORED} group by strategy" for h in (2, 3, 5) for t in (0.0, 0.02, 0.05))
    + ")",
)
def sweep(s, d):
    """Horizons and tolerances at once: windows for each horizon over one shuffle, then one aggregation."""
    grid = _medians(s, d)
    price = F.when(F.col("in_stock"), F.col("price_cents"))
    days = Window.partitionBy("product_id").orderBy("day_idx")
    last = F.max("day_idx").over(Window.partitionBy("product_id"))
    seen = grid.withColumns({f"least_{h}": F.min(price).over(days.rowsBetween(1, h)) for h in (2, 3, 5)} | {"last": last})
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(float(t)).alias("tolerance"), F.col(f"least_{h}").alias("least")) for h in (2, 3, 5) for t in (0.0, 0.02, 0.05)))
    rows = seen.withColumn("p", F.explode(each)).select("product_id", "day_idx", "price_cents", "median_cents", "last", "p.*")
    fits = F.col("price_cents").isNotNull() & (F.col("day_idx") + F.col("horizon") <= F.col("last")) & F.col("least").isNotNull()
    rows = rows.withColumn("dropped", F.when(fits, (F.col("least") < F.col("price_cents")) & (F.col("price_cents") - F.col("least") >= F.col("tolerance") * F.col("price_cents"))))
    return backtest.tally(backtest.scored(backtest.strategies(rows), WARMUP), ["horizon", "tolerance", "strategy"])


_FOLLOW = f"""select *, coalesce(first_value(case when call <> 'wait' then price_cents end ignore nulls) over (partition by strategy, product_id order by day_idx rows between current row and {HORIZON - 1} following),
  first_value(price_cents ignore nulls) over (partition by strategy, product_id order by day_idx rows between {HORIZON} following and {HORIZON + 14} following)) as paid_cents from calls"""


@query(
    "A19_W08_policy",
    with_("grid", **_GRID, followed=_FOLLOW)
    + f"select strategy, round(avg(cast(paid_cents as double) / price_cents), 9) as mean_ratio, count(*) filter (where paid_cents < price_cents) as paid_less, count(*) filter (where paid_cents = price_cents) as paid_same, count(*) filter (where paid_cents > price_cents) as paid_more, count(*) filter (where paid_cents is null) as unresolved from followed where {_SCORED} group by 1",
)
def policies(s, d):
    followed = backtest.follow(_calls(s, d), HORIZON)
    return backtest.policy(backtest.scored(followed, WARMUP), ["strategy"]).withColumn("mean_ratio", F.round("mean_ratio", 9))


@query(
    "A23_threshold_sweep",
    "with scored as (select l.toxic = 1 as truth, least(1.0, d.n_chars / 4000.0) as score from labels l join documents d using (doc_id)), n as (select step, count(*) filter (where score >= step / 20.0 and truth) as tp, count(*) filter (where score >= step / 20.0 and not truth) as fp, count(*) filter (where not score >= step / 20.0 and truth) as fn from scored cross join (select unnest(range(21)) as step) group by 1), r as (select *, coalesce(cast(tp as double) / nullif(tp + fp, 0), 1) as precision, coalesce(cast(tp as double) / nullif(tp + fn, 0), 1) as recall from n) select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from r",
)
def threshold_sweep(s, d):
    docs = model.read(s, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    rows = model.read(s, d, "labels").join(docs, "doc_id").select((F.col("toxic") == 1).alias("truth"), "score")
    return community.threshold_sweep(rows)


@query(
    "A24_confusion",
    "select quality, count(*) filter (where g = 0) as said_0, count(*) filter (where g = 1) as said_1, count(*) as n from (select l.quality, case when d.n_chars > 500 then 1 else 0 end as g from labels l join documents d using (doc_id)) group by 1",
)
def confusion(s, d):
    docs = model.read(s, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("g"))
    rows = model.read(s, d, "labels").join(docs, "doc_id")
    return rows.groupBy("quality").agg(F.count_if(F.col("g") == 0).alias("said_0"), F.count_if(F.col("g") == 1).alias("said_1"), F.count("*").alias("n"))


@query(
    "J14_labels_join_and_skipped",
    "select case when d.doc_id is null then 'skipped' else 'judged' end as outcome, count(*) as n from labels l left join (select doc_id from documents where lang = 'en') d using (doc_id) group by 1",
)
def labels_join(s, d):
    docs = model.read(s, d, "documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("found"))
    return model.read(s, d, "labels").join(docs, "doc_id", "left").groupBy(F.when(F.col("found").isNull(), "skipped").otherwise("judged").alias("outcome")).agg(F.count("*").alias("n"))
