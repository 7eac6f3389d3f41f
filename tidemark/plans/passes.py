"""Registered queries of passes, sinks, evaluation, sources and the crawl queue."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import control, evaluate, passes, prices, resolve, sinks
from tidemark.plans import catalogue as base
from tidemark.plans import model
from tidemark.plans.catalogue import query
from tidemark.plans.model import AS_OF, AS_OF_SQL, with_
from tidemark.sources import config, specs, stores

_SEEN = "seen as (select offer_id, max(observed_at) as last_seen from raw_observations group by 1)"
_RUNS = "runs as (select distinct o_orderdate as started_at from orders where o_orderstatus <> 'P')"
_AFTER = "after as (select o.*, last_seen, retired as before, retired or last_seen < (select started_at from runs order by 1 desc limit 1 offset 39) as gone from offers o join seen using (offer_id))"


def _offers_seen(s, d) -> DataFrame:
    seen = model.observations(s, d).groupBy("offer_id").agg(F.max("observed_at").alias("last_seen"))
    return model.offers(s, d).join(seen, "offer_id")


def _runs(s, d) -> DataFrame:
    rows = model.read(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderdate").alias("started_at")).distinct()
    return rows.select("started_at", F.lit(True).alias("finished"), F.lit("crawl").alias("kind"))


@query(
    "D04_rollup_pass_of_a_run",
    with_("raw_observations", "offers", "observations")
    + f""", {_SEEN}, {_RUNS}, {_AFTER}, run as (select max(run_id) as id from observations),
    scope as (select distinct offer_id from observations, run where run_id = id union select offer_id from after where gone and not before),
    products_ as (select product_id from after join scope using (offer_id) where status in ('auto', 'reviewed') and not gone union select product_id from after where gone and not before)
    select 'offer' as grain, offer_id as key from scope union all select 'product', product_id from products_""",
)
def rollup_scope(s, d):
    """What a pass after the newest run recomputes, offers retired in it included."""
    rows = model.observations(s, d)
    run = rows.agg(F.max("run_id")).first()[0]
    made = passes.rollup_pass(rows, _offers_seen(s, d), _runs(s, d), model.products(s, d), AS_OF, run, 40)
    return made["offer_rollups"].select(F.lit("offer").alias("grain"), "key").unionByName(made["product_rollups"].select(F.lit("product").alias("grain"), "key"))


@query(
    "D06_signal_pass",
    with_("products", "series", "current", **base._PRODUCT, signals=base._SIGNAL)
    + f"select count(signal) as decided, count(*) filter (where signal = 'buy') as buys, count(*) filter (where signal = 'wait') as waits, count(*) filter (where signal = 'neutral') as neutrals, count(*) filter (where signal is null) as without_rollup, max(case when signal is not null then {AS_OF_SQL} end) as as_of from (select distinct p_size as key from part) left join signals using (key)",
)
def signal_pass(s, d):
    """Signals asked for by id; ids without a rollup are counted."""
    keys = model.products(s, d).select(F.col("product_id").alias("key"))
    rollups = prices.rollup_products(base._year(s, d), model.offers(s, d), keys, AS_OF)
    return passes.signal_pass(rollups, model.read(s, d, "part").select(F.col("p_size").cast("long").alias("key")))[1]


_OLD = f"select offer_id, count(*) as n, max(observed_at) as last_at from observations where observed_at <= {AS_OF_SQL} - interval 365 day group by 1"
_NEW = f"select offer_id, count(*) as n, max(observed_at) as last_at from observations where observed_at > {AS_OF_SQL} - interval 365 day group by 1"


@query("K01_K06_K07_upsert", with_("observations") + f", old as ({_OLD}), new as ({_NEW}) select * from new union all select * from old where offer_id not in (select offer_id from new)")
def upsert(s, d):
    """Rows of a later pass replace those of their key."""
    rows, cut = model.observations(s, d), F.lit(AS_OF - timedelta(days=365))
    each = lambda cond: rows.where(cond).groupBy("offer_id").agg(F.count("*").alias("n"), F.max("observed_at").alias("last_at"))
    return sinks.upsert(each(F.col("observed_at") <= cut), each(F.col("observed_at") > cut), ["offer_id"])


@query(
    "K02_offer_upsert",
    with_("offers", "observations")
    + f""", new as (select offer_id, 'seen ' || count(*) as title, case when bool_and(in_stock) then 'sku' end as sku, max(observed_at) as last_seen from observations where observed_at > {AS_OF_SQL} - interval 90 day group by 1)
    select o.offer_id, coalesce(n.title, 'old') as title, coalesce(n.sku, o.retailer) as sku, o.status, case when n.offer_id is null then o.retired else false end as retired, n.last_seen from offers o left join new n using (offer_id)""",
)
def offer_upsert(s, d):
    """Offers seen again: title and last sighting are new, an absent sku and the link stay, nothing seen is retired."""
    old = model.offers(s, d).select("offer_id", F.lit("old").alias("title"), F.col("retailer").alias("sku"), "status", "retired", F.lit(None).cast("timestamp_ntz").alias("last_seen"))
    seen = model.observations(s, d).where(F.col("observed_at") > F.lit(AS_OF - timedelta(days=90))).groupBy("offer_id").agg(F.concat(F.lit("seen "), F.count("*").cast("string")).alias("title"), F.when(F.bool_and("in_stock"), "sku").alias("sku"), F.max("observed_at").alias("last_seen"))
    new = seen.withColumns({"status": F.lit("pending"), "retired": F.lit(False)})
    return sinks.merge(old.withColumn("last_seen", F.col("last_seen").cast(dict(new.dtypes)["last_seen"])), new, ["offer_id"], kept=["status"], fallback=["sku"])


@query(
    "K04_product_upsert",
    with_("products")
    + ", new as (select distinct p_size::bigint as product_id, 'size ' || p_size as name from part) select coalesce(n.product_id, p.product_id) as product_id, coalesce(n.name, p.name) as name, case when p.product_id is null then 'fresh' else 'seed' end as spec from products p full join new n using (product_id)",
)
def product_upsert(s, d):
    """Names are rewritten, specifications of known products stay."""
    old = model.products(s, d).withColumn("spec", F.lit("seed"))
    size = F.col("p_size").cast("long")
    new = model.read(s, d, "part").select(size.alias("product_id"), F.concat(F.lit("size "), size.cast("string")).alias("name"), F.lit("fresh").alias("spec")).distinct()
    return sinks.merge(old, new, ["product_id"], kept=["spec"])


@query("K10_label_upsert", "with new as (select doc_id, 1 as quality, 0 as toxic from documents where lang = 'de'), old as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by 1) select * from new union all select * from old where doc_id not in (select doc_id from new)")
def label_upsert(s, d):
    new = model.read(s, d, "documents").where("lang = 'de'").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    old = model.read(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return sinks.upsert(old, new, ["doc_id"])


@query(
    "A09_sale_windows_nested",
    with_("series", listp=base._LIST, sales=base._SALES) + "select key, string_agg(strftime(start_at, '%Y-%m-%d') || '|' || strftime(end_at, '%Y-%m-%d') || '|' || min_price_cents || '|' || off_pct || '|' || days, ';' order by start_at desc) as windows from sales group by 1",
)
def nested(s, d):
    """The nested array as it is ordered: newest first."""
    totals = prices.sale_totals(prices.sales(base._series(s, d), prices.list_price(base._series(s, d))))
    one = lambda w: F.concat_ws("|", F.date_format(w["start_at"], "yyyy-MM-dd"), F.date_format(w["end_at"], "yyyy-MM-dd"), w["min_price_cents"], w["off_pct"], w["days"])
    return totals.select("key", F.array_join(F.transform("sale_windows", one), ";").alias("windows"))


def _spec_offers(s, d) -> DataFrame:
    return model.offers(s, d).withColumn("spec", F.create_map(F.lit("retailer"), "retailer", F.lit("status"), "status"))


_DERIVED = """, counted as (select product_id, k, v, count(*) as n from (select product_id, 'retailer' as k, retailer as v from offers where status in ('auto', 'reviewed') and not retired union all select product_id, 'status', status from offers where status in ('auto', 'reviewed') and not retired) group by 1, 2, 3),
  top as (select product_id, k, v from counted qualify row_number() over (partition by product_id, k order by n desc, v) = 1)"""


@query("A13_X51_derived_map", with_("offers") + _DERIVED + " select product_id, string_agg(k || '=' || v, ';' order by k) as spec from top group by 1")
def derived_map(s, d):
    rows = passes.derived_specs(_spec_offers(s, d))
    return rows.select("product_id", F.array_join(F.transform(F.array_sort(F.map_entries("spec")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("spec"))


@query("P03_K16_spec_overlay", with_("offers", "products") + _DERIVED + " select product_id, max(v) filter (where k = 'status') as status, 'seed' as retailer, true as changed from top group by 1")
def overlay(s, d):
    """A product's specification: derived, then the seed's own values on top; whether it must be written."""
    products = model.products(s, d).withColumn("spec", F.create_map(F.lit("retailer"), F.lit("seed")))
    rows = passes.overlaid(products, passes.derived_specs(_spec_offers(s, d)), products)
    return rows.select("product_id", F.col("spec")["status"].alias("status"), F.col("spec")["retailer"].alias("retailer"), "changed")


@query("A28_throughput", "select o_custkey as run_id, count(*) as pages, sum(left(o_orderpriority, 1)::bigint)::bigint as offers, (epoch_us(max(o_orderdate + left(o_orderpriority, 1)::int * interval 1 hour)) - epoch_us(min(o_orderdate))) / 1000000.0::double as seconds from orders group by 1")
def throughput(s, d):
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = model.read(s, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=n)).alias("finished_at"), n.cast("long").alias("offers"))
    return control.throughput(rows).drop("offers_per_second")


@query("O05_latest_runs", "select o_orderstatus as state, max_by(o_orderkey, (o_orderdate, o_orderkey)) as run_id, max(o_orderdate) as started_at from orders group by 1")
def latest_runs(s, d):
    return model.read(s, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"), F.max("o_orderdate").alias("started_at"))


_LINKS = """links as (select doc_id as subject, case when lang = 'en' then 1 when lang = 'de' then 0 end::bigint as product_id, least(1.0::double, n_chars / 4000.0::double) as score from documents),
  labelled as (select doc_id as subject, quality::bigint as product_id, toxic = 0 as truth from labels)"""


def _links(s, d) -> tuple[DataFrame, DataFrame]:
    docs = model.read(s, d, "documents").select(F.col("doc_id").alias("subject"), F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 0).cast("long").alias("product_id"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    return docs, model.read(s, d, "labels").select(F.col("doc_id").alias("subject"), F.col("quality").cast("long").alias("product_id"), (F.col("toxic") == 0).alias("truth"))


_JUDGED = "judged as (select a.subject, truth, case when l.product_id is not distinct from a.product_id then score else 0 end as score from labelled a join links l using (subject))"


@query(
    "D17_D21_link_evaluation",
    f"with {_LINKS}, {_JUDGED}, n as (select count(*) filter (where score >= 0.9 and truth) as tp, count(*) filter (where score >= 0.9 and not truth) as fp, count(*) filter (where score < 0.9 and truth) as fn, count(*) filter (where score >= 0.4 and score < 0.9) as in_review, count(*) as judged from judged) select *, coalesce(cast(tp as double) / nullif(tp + fp, 0), 1) as precision, coalesce(cast(tp as double) / nullif(tp + fn, 0), 1) as recall from n",
)
def link_point(s, d):
    """Precision and recall at the automatic threshold, and how many a person would see."""
    return evaluate.link_report(*_links(s, d), resolve.AUTO, resolve.REVIEW)["point"]


@query("U05_unjudged_links", f"with {_LINKS} select subject, product_id, score from links where score >= 0.9 and product_id is not null and subject in (select subject from labelled) and (subject, product_id) not in (select subject, product_id from labelled)")
def unjudged(s, d):
    return evaluate.unjudged(*_links(s, d), resolve.AUTO)


@query(
    "A24_D21_sentiment_confusion",
    with_("mentions")
    + """, r as (select sentiment as label, case community when 'en' then 'positive' when 'de' then 'negative' else 'neutral' end as said from mentions)
    select c.label, count(*) filter (where r.label = c.label and said = 'positive') as said_positive, count(*) filter (where r.label = c.label and said = 'negative') as said_negative, count(*) filter (where r.label = c.label and said = 'neutral') as said_neutral,
    avg(case when r.label = said then 1.0 else 0.0 end)::double as accuracy, coalesce(cast(count(*) filter (where r.label = c.label and said = c.label) as double) / nullif(count(*) filter (where said = c.label), 0), 0) as precision,
    coalesce(cast(count(*) filter (where r.label = c.label and said = c.label) as double) / nullif(count(*) filter (where r.label = c.label), 0), 0) as recall from r cross join (values ('positive'), ('negative'), ('neutral')) c(label) group by 1""",
)
def sentiment_confusion(s, d):
    said = F.when(F.col("community") == "en", "positive").when(F.col("community") == "de", "negative").otherwise("neutral")
    return evaluate.confusion(model.mentions(s, d).select(F.col("sentiment").alias("label"), said.alias("said")))


def _queue(s, d) -> DataFrame:
    return model.offers(s, d).select("offer_id", "status", F.col("product_id").alias("proposed_id"), F.lit(None).cast("long").alias("product_id"), ((F.col("offer_id") % 1000) / 1000.0).alias("score"))


@query("O06_review_queue", with_("offers") + "select offer_id, product_id as proposed_id, (offer_id % 1000) / 1000.0::double as score from offers where status = 'pending' order by 3 desc, 1 limit 50")
def review_queue(s, d):
    return passes.review_queue(_queue(s, d)).select("offer_id", "proposed_id", "score")


@query(
    "D16_review",
    with_("offers")
    + """, v as (select offer_id, case when retailer in ('retailer 1', 'retailer 2') then 'accept' else 'reject' end as verdict, case when retailer = 'retailer 2' then 99 end::bigint as given from offers where retailer <> 'retailer 0')
    select o.offer_id, case when status <> 'pending' then status when verdict = 'accept' then 'reviewed' when verdict = 'reject' then 'rejected' else status end as status, case when status = 'pending' and verdict = 'accept' then coalesce(given, product_id) end as product_id, case when status = 'pending' and verdict is not null then null else product_id end as proposed_id from offers o left join v using (offer_id)""",
)
def reviewed(s, d):
    """Decisions on every offer: only pending ones change."""
    verdict = F.when(F.col("retailer").isin("retailer 1", "retailer 2"), "accept").otherwise("reject")
    given = F.when(F.col("retailer") == "retailer 2", 99).cast("long")
    decisions = model.offers(s, d).where("retailer <> 'retailer 0'").select("offer_id", verdict.alias("verdict"), given.alias("product_id"))
    return passes.review(_queue(s, d), decisions).select("offer_id", "status", "product_id", "proposed_id")


@query("D15_resolution_pass")
def resolution_pass(s, d):
    """Parts as listings of their brands, against a catalog of their names' words; with automatic links reopened."""
    part = model.read(s, d, "part")
    offers = part.select(F.col("p_partkey").alias("offer_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.create_map(F.lit("type"), "p_type").alias("spec"), F.when(F.col("p_size") > 40, "reviewed").when(F.col("p_size") > 30, "auto").otherwise("pending").alias("status"), F.col("p_size").cast("long").alias("product_id"), F.lit(None).cast("long").alias("proposed_id"), F.lit(None).cast("double").alias("score"))
    products = [resolve.Product(10 * b + k, f"brand {b}", m) for b in range(1, 26) for k, m in enumerate(("ring", "blue bolt", "widget", "large widget"))]
    return passes.resolution_pass(offers, products, rescore=True)[1]


@query("X13_rank", "select p_partkey, p_size as rank from part")
def rank(s, d):
    """Ranks stated before names in made lists."""
    text = F.concat(F.lit("my list\n#"), F.col("p_size").cast("string"), F.lit(" the "), "p_name", F.lit("\n"))
    return model.read(s, d, "part").select("p_partkey", T.ranks(text, F.lower("p_name")).alias("rank"))


@query("X14_domain", "select page_id, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '([^.]+\\.[^.]+)$', 1) as domain from pages")
def domain(s, d):
    return model.read(s, d, "pages").select("page_id", T.parse_domain(F.col("url")).alias("domain"))


@query("X03_X04_X06_tokens", "select p_partkey, len(string_split(p_name, ' ')) as tokens, coalesce(list_position(string_split(p_name, ' '), 'widget'), 0) - 1 as at, regexp_matches(p_brand, '[0-9]') as digit from part")
def tokens(s, d):
    t = T.tokens(F.col("p_name"))
    return model.read(s, d, "part").select("p_partkey", F.size(t).cast("long").alias("tokens"), T.index_of_run(t, F.array(F.lit("widget"))).alias("at"), T.has_digit(F.col("p_brand")).alias("digit"))


@query("U02_sibling_tokens", "with own as (select distinct p_brand, p_name, unnest(string_split(p_name, ' ')) as t from part) select distinct p.p_brand, p.p_name, coalesce((select string_agg(distinct o.t, ' ' order by o.t) from own o where o.p_brand = p.p_brand and not list_contains(string_split(p.p_name, ' '), o.t)), '') as siblings from part p")
def siblings(s, d):
    """Tokens of a brand's other names, without a name's own."""
    names = model.read(s, d, "part").select("p_brand", "p_name").distinct()
    every = names.select("p_brand", F.explode(F.split("p_name", " ")).alias("t")).groupBy("p_brand").agg(F.array_sort(F.collect_set("t")).alias("all"))
    return names.join(every, "p_brand").select("p_brand", "p_name", F.array_join(F.array_except("all", F.split("p_name", " ")), " ").alias("siblings"))


@query(
    "S02_X15_X52_store_variants",
    "select p_name || ' — ' || p_type as title, 'https://x.example/products/' || replace(p_name, ' ', '-') || '?variant=' || p_partkey as url, p_brand as brand, cast(round(cast(p_retailprice as decimal(20,2)) * 100, 0) as bigint) as price_cents, p_size > 25 as in_stock from part where p_size > 5",
)
def store_variants(s, d):
    """Parts as product JSON, a body for each brand; small ones have a price of zero and drop out."""
    part = model.read(s, d, "part")
    price = F.when(F.col("p_size") > 5, F.col("p_retailprice").cast("decimal(20,2)").cast("string")).otherwise("0.00")
    variant = F.array(F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.lit(" ").alias("sku"), price.alias("price"), (F.col("p_size") > 25).alias("available")))
    product = F.struct(F.col("p_name").alias("title"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("handle"), F.col("p_brand").alias("vendor"), variant.alias("variants"))
    bodies = part.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("body"))
    return stores.variants(bodies, "https://x.example").select("title", "url", "brand", "price_cents", "in_stock")


@query("S14_page_urls", "select '/c/' || n_name || '?limit=250&page=' || page as url from nation cross join (select unnest(range(1, 4)) as page)")
def page_urls(s, d):
    paths = model.read(s, d, "nation").select(F.concat(F.lit("/c/"), "n_name", F.lit("?limit={limit}&page={page}")).alias("path"))
    return stores.page_urls(paths, 3, 250).select("url")


@query("S04_X44_X53_forum_posts", "select 't3_' || conv_id as source_id, text, make_timestamp((1000000000 + conv_id) * 1000000) as posted_at from conversations where turn = 0 and role = 'user' and conv_id > 20")
def forum_posts(s, d):
    """First turns as posts of listing JSON: those of others than users are deleted, those before the cutoff are left."""
    rows = model.read(s, d, "conversations").where("turn = 0")
    name = F.concat(F.lit("t3_"), F.col("conv_id").cast("string"))
    data = F.struct(name.alias("name"), F.lit("title").alias("title"), F.col("text").alias("selftext"), F.when(F.col("role") == "user", "someone").otherwise("[deleted]").alias("author"), (1_000_000_000.0 + F.col("conv_id")).alias("created_utc"), F.lit("/p").alias("permalink"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("t3").alias("kind"), data.alias("data"))).alias("children")).alias("data")))
    return stores.posts(rows.select(body.alias("body")), F.lit(datetime(2001, 9, 9, 1, 47, 0)).cast("timestamp")).select("source_id", "text", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query(
    "X21_monitor_spec",
    "select p_partkey, case p_type when 'ECONOMY' then '4k' when 'SMALL' then 'ultrawide-1440p' else '1080p' end as resolution, case when p_type = 'SMALL' then '21:9' end as aspect_ratio, case when p_size >= 30 then p_size || '' end as refresh_hz, case when p_size >= 10 then p_size || '.0' end as size_in, case when p_size > 25 then 'true' end as curved from part",
)
def monitor_spec(s, d):
    """Parts as monitors: what a title says of size, resolution, shape, rate and curve."""
    sharp = F.when(F.col("p_type") == "ECONOMY", "4K UHD").when(F.col("p_type") == "SMALL", "UltraWide QHD").otherwise("Full HD")
    size = F.col("p_size").cast("string")
    title = F.concat(F.lpad(size, 2, "0"), F.lit('" '), sharp, F.lit(" "), size, F.lit("Hz"), F.when(F.col("p_size") > 25, " Curved").otherwise(""), F.lit(" Monitor"))
    spec = specs.spec_of("monitors", title, F.array(F.lit("Gaming")), T.normalize_ascii)
    # the titles' work is far more than the few bytes of a part, so the size of its files must not set the number of tasks
    part = model.read(s, d, "part").select("p_partkey", "p_type", "p_size").repartition("p_partkey")
    return part.withColumn("spec", spec).select("p_partkey", *(F.col("spec")[k].alias(k) for k in ("resolution", "aspect_ratio", "refresh_hz", "size_in", "curved")))


_FIELDS = {"kind": config.Field("string", ("ECONOMY", "SMALL")), "count": config.Field("integer"), "weight": config.Field("number"), "wired": config.Field("boolean")}


@query("F11_spec_coercion", "select p_partkey, concat_ws(';', case when p_type in ('ECONOMY', 'SMALL') then 'kind=' || p_type end, case when p_size > 20 then 'count=' || p_size end, case when p_size % 2 = 0 then 'wired=true' end) as spec, concat_ws(',', case when p_size <= 20 then 'count' end, 'extra', case when p_type not in ('ECONOMY', 'SMALL') then 'kind' end, case when p_size % 2 = 1 then 'wired' end) as rejected from part")
def coercion(s, d):
    """What of loose specifications fits a schema, and what does not."""
    n = F.col("p_size")
    loose = F.create_map(F.lit("kind"), "p_type", F.lit("count"), F.when(n > 20, n.cast("string")).otherwise("few"), F.lit("wired"), F.when(n % 2 == 0, " TRUE").otherwise("yes"), F.lit("extra"), F.lit("x"))
    rows = model.read(s, d, "part").withColumn("loose", loose)
    flat = F.array_join(F.transform(F.map_entries(config.validated(F.col("loose"), _FIELDS)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("p_partkey", flat.alias("spec"), F.array_join(config.rejected(F.col("loose"), _FIELDS), ",").alias("rejected"))


@query("C01_enqueue", "select distinct o_custkey as run_id, o_orderstatus as retailer, 'p' as path, left(o_orderpriority, 1)::int as page from orders")
def enqueue(s, d):
    """A second cycle's pages: what a run has already is not asked for again."""
    key = model.read(s, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("retailer"), F.lit("p").alias("path"), F.substring("o_orderpriority", 1, 1).cast("int").alias("page"))
    return control.enqueue(key.where("retailer = 'F'").distinct(), key)


@query("C02_J11_claim_order", "select task_id, row_number() over (partition by domain order by place) as turn from (select o_orderkey as task_id, o_custkey as domain, row_number() over (order by l.at nulls first, o_orderkey) as place from orders left join (select c_custkey as domain, timestamp '2001-01-01' + c_custkey % 7 * interval 1 day as at from customer where c_custkey % 2 = 0) l on l.domain = o_custkey where o_orderstatus = 'O')")
def claim_order(s, d):
    """The queue with its rate limits; the turn of each task within its domain."""
    tasks = model.read(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("domain"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"))
    limits = model.read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("domain"), (F.lit(datetime(2001, 1, 1)) + F.make_dt_interval(days=(F.col("c_custkey") % 7).cast("int"))).alias("next_allowed_at"))
    order = Window.partitionBy("domain").orderBy(F.asc_nulls_first("next_allowed_at"), "task_id")
    return control.claimable(tasks, limits).select("task_id", F.row_number().over(order).cast("long").alias("turn"))


@query(
    "C03_X35_finish",
    "select o_orderkey as task_id, case when o_orderstatus <> 'O' or o_custkey % 3 = 0 then 'leased' when p <= 2 then 'done' when p >= 3 then case when p >= 4 then 'dead' else 'retry' end end as state, case when o_orderstatus = 'O' and o_custkey % 3 <> 0 and p = 3 then timestamp '2001-01-01 00:02:00' end as retry_at from (select *, left(o_orderpriority, 1)::int as p from orders)",
)
def finish(s, d):
    """Reports of one worker: tasks of others, and those whose lease is over, stay as they are; failures wait twice as long each time."""
    now, p = datetime(2001, 1, 1), F.substring("o_orderpriority", 1, 1).cast("int")
    rows = model.read(s, d, "orders")
    lease = F.when(F.col("o_custkey") % 3 == 0, F.lit(now - timedelta(minutes=1))).otherwise(F.lit(now + timedelta(minutes=1)))
    tasks = rows.select(F.col("o_orderkey").alias("task_id"), F.lit("leased").alias("state"), F.when(F.col("o_orderstatus") == "O", "me").otherwise("other").alias("worker"), lease.cast("timestamp").alias("lease_until"), p.alias("attempts"), F.lit(None).cast("timestamp").alias("retry_at"))
    done = control.finish(tasks, rows.select(F.col("o_orderkey").alias("task_id"), (p <= 2).alias("ok")), "me", now, attempts=4)
    return done.select("task_id", "state", F.col("retry_at").cast("timestamp_ntz").alias("retry_at"))


@query("P02_view_columns", with_("offers", "offer_series", "offer_current", **base._OFFER) + "select key, cast(synthetic_365d as double) / nullif(observations_365d, 0) as synthetic_share, current_observed_at < timestamp '2001-06-01 00:00:00' as stale from rollups")
def view_columns(s, d):
    rows = base.offer_rollups(s, d)
    share = F.try_divide(F.col("synthetic_365d").cast("double"), F.col("observations_365d").cast("double"))
    return rows.select("key", share.alias("synthetic_share"), (F.col("current_observed_at") < F.lit(datetime(2001, 6, 1))).alias("stale"))
