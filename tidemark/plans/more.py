"""Registered queries of search, text functions, resolution, mentions and sources."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import backtest, prices, resolve, serve
from tidemark.operators.backfill import backfill, missing
from tidemark.operators.classifier import call, chronological, features, train
from tidemark.plans import catalogue as base
from tidemark.plans import model
from tidemark.plans.catalogue import query
from tidemark.plans.model import with_
from tidemark.session import kept
from tidemark.sources.specs import keyboard_spec

#: A small catalog for the resolution queries: two brands of made-up names that the documents' words may hold.
PRODUCTS = [
    resolve.Product(1, "the", "and"), resolve.Product(2, "the", "with that"), resolve.Product(3, "the", "with that are"),
    resolve.Product(4, "von", "und der"), resolve.Product(5, "que", "de la", ("de les",)), resolve.Product(6, "les", "une"),
]


def _search_frames(s, d):
    products = model.products(s, d).select("product_id", "name", F.create_map(F.lit("kind"), F.when(F.col("product_id") % 2 == 0, "even").otherwise("odd")).alias("spec"))
    offers = model.offers(s, d).withColumn("spec", F.create_map(F.lit("retailer"), "retailer"))
    rollups = base.product_rollups(s, d).withColumnRenamed("key", "product_id")
    # some products have no signal row yet
    signals = base.deal_signals(s, d).where("percentile_365d >= 0.3").select(F.col("key").alias("product_id"), "signal")
    return products, offers, rollups, base.offer_rollups(s, d).withColumnRenamed("key", "offer_id"), signals, base._consensus(s, d).select("product_id", "score", "mention_count")


_LIVE_OFFERS = f"""offers_hit as (select distinct on (o.product_id) o.product_id, o.offer_id, r.current_price_cents as price_cents, r.current_in_stock as in_stock from offers o join offer_rollups r on r.key = o.offer_id
  where o.status in ('auto', 'reviewed') and not o.retired and r.current_price_cents is not null and (r.current_in_stock or not {{stock}}) and r.current_price_cents >= {{low}} {{high}} {{facet}}
  order by o.product_id, r.current_in_stock desc, r.current_price_cents, o.offer_id)"""


def _search_sql(order: str, stock: str = "true", low: int = 0, high: int | None = None, facet: str = "", signal: str = "", page: str = "limit 50") -> str:
    own = {k if k != "rollups" else "offer_rollups": v for k, v in base._OFFER.items()}
    # both grains in one statement: the offer chain under names of its own
    names = {"keys": "okeys", "listp": "olistp", "sales": "osales", "totals": "ototals", "measures": "omeasures"}
    chain = {}
    for k, v in own.items():
        for a, b in names.items():
            v = v.replace(f"from {a} ", f"from {b} ").replace(f"join {a} ", f"join {b} ").replace(f"from {a}\n", f"from {b}\n")
            if v.endswith(f"from {a}"):
                v = v[: -len(a)] + b
        chain[names.get(k, k)] = v
    hit = _LIVE_OFFERS.format(stock=stock, low=low, high="" if high is None else f"and r.current_price_cents <= {high}", facet=facet)
    head = with_("products", "offers", "series", "current", "offer_series", "offer_current", "mentions", **base._PRODUCT, signals=base._SIGNAL, consensus=base._CONSENSUS, **chain)
    return (
        head.rstrip()
        + ", "
        + hit
        + f""" select *, count(*) over () as total from (select p.product_id, p.name, r.current_price_cents, r.percentile_365d, s.signal, c.score, c.mention_count, m.offer_id, m.price_cents, m.in_stock
      from products p join rollups r on r.key = p.product_id left join (select s.* from signals s join rollups x on x.key = s.key where x.percentile_365d >= 0.3) s on s.key = p.product_id left join consensus c on c.product_id = p.product_id join offers_hit m on m.product_id = p.product_id {signal}) order by {order} {page}"""
    )


_SHOWN = ["product_id", "name", "current_price_cents", "percentile_365d", "signal", "score", "mention_count", "offer_id", "price_cents", "in_stock", "total"]


def _search(s, d, **more) -> DataFrame:
    return serve.search(*_search_frames(s, d), **more).select(*_SHOWN).withColumn("score", F.round("score", 9)).withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


query("D29_O01_search_deal", _search_sql("(signal = 'buy') desc nulls first, percentile_365d nulls last, price_cents, product_id", page="limit 10"))(lambda s, d: _search(s, d, sort="deal", limit=10))
query("D29_F03_F04_search_price_facet", _search_sql("price_cents, product_id", low=4500, high=6500, facet="and o.product_id % 2 = 0 and o.retailer = 'retailer 3'"))(
    lambda s, d: _search(s, d, sort="price", low=4500, high=6500, spec={"kind": "even", "retailer": "retailer 3"})
)
query("D29_O02_search_name_page2", _search_sql("name, product_id", page="limit 5 offset 5"))(lambda s, d: _search(s, d, sort="name", limit=5, offset=5))
query("D29_search_consensus", _search_sql("score desc nulls last, mention_count desc nulls last, product_id", stock="false"))(lambda s, d: _search(s, d, sort="consensus", in_stock_only=False))
query("D30_deals", _search_sql("percentile_365d nulls last, price_cents, product_id", signal="where s.signal = 'buy'"))(lambda s, d: _search(s, d, sort="deal", signal="buy"))


@query(
    "D31_O10_detail_offers",
    with_("offers", "offer_series", "offer_current", **base._OFFER)
    + "select offer_id, retailer, current_price_cents as price_cents, current_in_stock as in_stock, row_number() over (order by current_in_stock desc nulls last, current_price_cents nulls last, offer_id) as place from offers join rollups on key = offer_id where product_id = 7 and status in ('auto', 'reviewed') and not retired",
)
def detail_offers(s, d):
    rolled = base.offer_rollups(s, d).select(F.col("key").alias("offer_id"), F.col("current_price_cents").alias("price_cents"), F.col("current_in_stock").alias("in_stock"))
    rows = model.offers(s, d).where(prices.live() & (F.col("product_id") == 7)).join(rolled, "offer_id")
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc_nulls_last("in_stock"), F.asc_nulls_last("price_cents"), "offer_id"))
    return rows.select("offer_id", "retailer", "price_cents", "in_stock", place.alias("place"))


@query("X01_normalize_ascii", "select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) as norm from documents")
def normalized(s, d):
    return model.read(s, d, "documents").select("doc_id", T.normalize_ascii(F.col("text")).alias("norm"))


@query("X02_contains_name", "select doc_id, contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) || ' ', ' with that ') as named from documents")
def contains(s, d):
    return model.read(s, d, "documents").select("doc_id", T.contains_name(T.normalize_ascii(F.col("text")), F.lit("with that")).alias("named"))


@query("X05_split_alnum", "select p_partkey, array_to_string(regexp_extract_all(replace(lower(p_brand), '#', ''), '[0-9]+|[^0-9]+'), ' ') as parts from part")
def split_alnum(s, d):
    return model.read(s, d, "part").select("p_partkey", F.array_join(T.letters_and_digits(F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))), " ").alias("parts"))


@query("X09_X10_money", "select o_orderkey, cast(round(cast(cast(o_totalprice as decimal(20,2)) as decimal(20,6)) * 100, 0) as bigint) as cents, o_orderkey * 100 as found from orders")
def money(s, d):
    rows = model.read(s, d, "orders")
    said = F.concat(F.lit("only $"), F.format_number("o_orderkey", 0), F.lit(" today"))
    return rows.select("o_orderkey", T.to_cents(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("cents"), T.cents_in(said).alias("found"))


@query("X16_sha256", "select doc_id, sha256(text) as digest from documents")
def digest(s, d):
    return model.read(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("X41_months", "select date_trunc('month', o_orderdate)::date as month, strftime(o_orderdate, '%Y_%m') as name, count(*) as n from orders group by 1, 2")
def months(s, d):
    rows = model.read(s, d, "orders")
    return rows.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.date_format("o_orderdate", "yyyy_MM").alias("name")).agg(F.count("*").alias("n"))


@query("X11_sentences", "select doc_id, len(string_split_regex(replace(text, chr(13), chr(10)), '\\n+')) as lines from documents")
def lines(s, d):
    return model.read(s, d, "documents").select("doc_id", F.size(F.split("text", r"[\r\n]+", -1)).cast("long").alias("lines"))


@query(
    "J12_blocking",
    "with l as (select doc_id, lang, trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) as title from documents), b(brand, product_id) as (values ('de', 1), ('de', 2), ('the', 3), ('von', 4)) select doc_id as offer_id, product_id from l join b on brand = lang union all select doc_id, product_id from l join b on contains(' ' || title || ' ', ' ' || brand || ' ') where lang <> 'de'",
)
def blocking(s, d):
    listings = model.read(s, d, "documents").select(F.col("doc_id").alias("offer_id"), F.col("lang").alias("brand"), T.normalize_ascii(F.col("text")).alias("title_norm"))
    catalog = s.createDataFrame([(1, "de"), (2, "de"), (3, "the"), (4, "von")], "product_id int, brand string")
    return resolve.block_pairs(listings, catalog)


@query("D13_D14_resolve_listings")
def resolved(s, d):
    """Every line of every document as a listing's title."""
    lines = model.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "title"))
    rows = lines.select((F.col("doc_id") * 100_000 + F.col("line")).alias("offer_id"), F.lit("the").alias("brand"), "title", F.create_map(F.lit("a"), F.lit("b")).alias("spec"))
    return resolve.resolve_listings(rows, PRODUCTS).withColumn("reasons", F.array_join("reasons", "; "))


_FORMS = resolve.name_forms(PRODUCTS)
_CLAIMS = f"""with t as (select doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' ') as t from documents),
  forms(form, size, product_id, name, otherwise, words, digit) as (values {', '.join(f"('{f[0]}', {f[1]}, {f[2]}, {f[3]}, {f[4]}, {f[5]}, {str(f[6]).lower()})" for f in _FORMS)}),
  dim(product_id, brand, siblings) as (values {', '.join(f"({p.product_id}, '{p.brand}', {sorted(resolve.Catalog(PRODUCTS).siblings[p.product_id])}::varchar[])" for p in PRODUCTS)}),
  grams as (select doc_id, i, size, array_to_string(t[i:i + size - 1], ' ') as form, coalesce(t[i - 1], '') as l, coalesce(t[i + size], '') as r from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from t) cross join (select distinct size from (select size from forms union all select 1)) where i + size - 1 <= len(t)),
  hits as (select doc_id, product_id, name, f.otherwise, i, f.size, l, r, words, digit from grams g join forms f on f.form = g.form and f.size = g.size),
  each as (select * from hits qualify row_number() over (partition by doc_id, product_id, name order by otherwise, i) = 1),
  best as (select * from each qualify row_number() over (partition by doc_id, product_id order by size desc, name) = 1),
  stated as (select distinct doc_id, form as brand from grams where size = 1),
  known as (select b.*, brand, s.brand is not null as named, siblings from best b join dim using (product_id) left join stated s using (doc_id, brand))
  select doc_id as mention_id, product_id, i - 1 as start, size, round(case when words = 1 and not named and not digit then 0 else greatest(0, 1 - 0.35 * least(len(list_intersect(list_distinct([l, r]), siblings)), 2)
    - case when len(list_filter(list_distinct([l, r]), lambda w: w in ('the', 'von', 'que', 'les') and w <> brand)) > 0 then 0.35 else 0 end - case when words = 1 and not named then 0.2 else 0 end) end, 9) as score from known"""


@query("D18_J13_claims", _CLAIMS)
def found_claims(s, d):
    """Every product that a text may mean, with its place and score."""
    rows = model.read(s, d, "documents").select(F.col("doc_id").alias("mention_id"), T.normalize_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    return resolve.claims(rows, PRODUCTS).select("mention_id", "product_id", F.col("start").cast("long").alias("start"), "size", F.round("score", 9).alias("score"))


@query("D18_D20_mentions")
def found_mentions(s, d):
    return resolve.find_mentions(model.read(s, d, "documents").select(F.col("doc_id").alias("mention_id"), "text"), PRODUCTS)


@query("S03_html_links")
def html_links(s, d):
    from tidemark.sources.pages import links

    return links(model.read(s, d, "pages"))


#: The rule's inputs of every product on every day, by joins of points with the days that see them.
_ASOF = """, span as (select min(cast(observed_at as date)) as a, max(cast(observed_at as date)) as z from observations),
    pts as (select product_id as key, offer_id, observed_at, price_cents, in_stock, synthetic, date_diff('day', (select a from span), cast(observed_at as date)) as d from observations join linked using (offer_id)),
    days as (select unnest(range((select date_diff('day', a, z) + 1 from span))) as n),
    stretches as (select *, least(coalesce(lead(d) over (partition by offer_id order by observed_at) - 1, d + 364), d + 364) as e from pts),
    now as (select key, n, min_by(struct_pack(p := price_cents, s := in_stock, o := offer_id), (case when in_stock then 0 else 1 end, price_cents, -epoch_us(observed_at), offer_id)) as c from stretches join days on n between d and e group by 1, 2),
    points as (select key, observed_at, d, min(price_cents) as price_cents, bool_or(synthetic) as synthetic from pts where in_stock group by 1, 2, 3),
    seen as (select key, n, observed_at, price_cents, synthetic from points join days on n between d and d + 364),
    listed as (select key, n, price_cents as list_price_cents from (select key, n, price_cents, row_number() over (partition by key, n order by count(*) desc, price_cents desc) as rn from seen group by 1, 2, 3) where rn = 1),
    flagged as (select *, price_cents * 10 <= list_price_cents * 9 as sale, lag(price_cents * 10 <= list_price_cents * 9, 1, false) over w as before, lag(cast(observed_at as date)) over w as day_before from seen join listed using (key, n) window w as (partition by key, n order by observed_at)),
    yearly as (select key, n, max(list_price_cents) as list_price_cents, min(price_cents) as min_365d, cast(round_even(quantile_cont(price_cents, 0.5), 0) as int) as median_365d, max(price_cents) as max_365d, cast(count(*) filter (where price_cents < now.c.p) as double) / count(*) as percentile_365d,
      count(*) filter (where sale and (not before or cast(observed_at as date) <> day_before)) as sale_days_365d, count(*) filter (where sale and not before) as sale_windows_n, max(observed_at) filter (where sale) as last_sale_ended_at, count(*) as observations_365d, count(*) filter (where synthetic) as synthetic_365d
      from flagged join now using (key, n) group by 1, 2),
    grid as (select key, n, c.p as current_price_cents, c.s as current_in_stock, c.o as current_offer_id, list_price_cents, min_365d, median_365d, max_365d, percentile_365d, coalesce(sale_days_365d, 0) as sale_days_365d, coalesce(sale_windows_n, 0) as sale_windows_n, last_sale_ended_at, coalesce(observations_365d, 0) as observations_365d, coalesce(synthetic_365d, 0) as synthetic_365d from now left join yearly using (key, n))"""


def _span(s, d):
    row = model.observations(s, d).agg(F.to_date(F.min("observed_at")).alias("a"), F.to_date(F.max("observed_at")).alias("z")).first()
    return (row.a, row.z) if row.a else (date(1970, 1, 1), date(1970, 1, 1))


def _asof(s, d):
    return prices.asof_grid(model.observations(s, d), model.offers(s, d), *_span(s, d))


@query("D07_J15_asof_grid", with_("observations", "linked") + _ASOF + " select * exclude (n), cast((select a from span) + n * interval 1 day as date) as day from grid")
def asof_grid(s, d):
    """Every product on every day from the first observation to the last."""
    return _asof(s, d)


def _rule_days(s, d):
    first, last = _span(s, d)
    return kept(backtest.rule_days(_asof(s, d), first, (last - first).days + 1), "days")


def _rule_sql(buy: float = 0.2, wait: float = 0.5, windows: int = 1) -> str:
    sale, low = "current_price_cents * 10 <= list_price_cents * 9", "current_price_cents <= min_365d * 1.05::double"
    return f"""case when current_price_cents is null or not coalesce(current_in_stock, false) or observations_365d < 30 then 'neutral' when {sale} and ({low} or percentile_365d <= {buy}) then 'buy'
      when sale_days_365d > 0 and sale_windows_n >= {windows} and (not {sale} or percentile_365d >= {wait}) then 'wait' else 'neutral' end"""


def _judged_sql(h: int, tolerance: float) -> str:
    return f"""select *, case when buyable is not null and day_idx + {h} <= max(day_idx) over (partition by product_id) and least is not null then least < buyable and buyable - least >= {tolerance}::double * buyable end as dropped
      from (select *, min(buyable) over (partition by product_id order by day_idx rows between 1 following and {h} following) as least from dense)"""


_DENSE = f""", dense as (select *, median(buyable) over (partition by product_id order by day_idx rows between 364 preceding and current row) as median_cents, {_rule_sql()} as signal from (
    select p.key as product_id, days.n as day_idx, grid.* exclude (key, n), case when current_in_stock then current_price_cents end as buyable from (select distinct key from now) p cross join days left join grid on grid.key = p.key and grid.n = days.n))"""
_BOTH = "unnest([struct_pack(s := 'always_buy', c := 'buy'), struct_pack(s := 'below_median', c := case when median_cents is null then 'neutral' when buyable < median_cents then 'buy' else 'wait' end), struct_pack(s := 'rule', c := signal)]) as x"


def _section(name: str, of: str, source: str, calls: str = _BOTH, cond: str = "true") -> str:
    return f"select '{name}' as section, {of} as of_, {base._TALLY} from (select *, x.s as strategy, x.c as call from (select *, {calls} from ({source}) where day_idx >= 90 and dropped is not null)) where {cond} group by 2"


def _sweep_calls() -> str:
    points = [("buy", b, b, 0.5, 1) for b in backtest.BUY_SWEEP if b < 0.5] + [("wait", w, 0.2, w, 1) for w in backtest.WAIT_SWEEP if w > 0.2] + [("windows", float(n), 0.2, 0.5, n) for n in backtest.WINDOW_SWEEP]
    return "unnest([" + ", ".join(f"struct_pack(s := '{a} {t}', c := {_rule_sql(b, w, n)})" for a, t, b, w, n in points) + "]) as x"


_REPORT = " union all ".join(
    [
        _section("headline", "strategy", _judged_sql(30, 0.02)),
        _section("rule_days", "strategy", _judged_sql(30, 0.02), cond="signal <> 'neutral' and strategy <> 'rule'"),
        *(_section("by_horizon", f"'{h} ' || strategy", _judged_sql(h, 0.02)) for h in backtest.HORIZONS),
        *(_section("by_tolerance", f"'{t} ' || strategy", _judged_sql(30, t)) for t in backtest.TOLERANCES),
        _section("sweeps", "strategy", _judged_sql(30, 0.02), _sweep_calls()),
        _section("products", "product_id || ' ' || strategy", _judged_sql(30, 0.02)),
    ]
)


@query("D08_A18_A21_A22_report", with_("observations", "linked") + _ASOF + _DENSE + _REPORT)
def report(s, d):
    """All tallies of the backtest of the deal rule against both baselines: 30 days ahead, 2 %, 90 days of warm-up."""
    tables = backtest.report(_rule_days(s, d))
    tables = {k: tables[k] for k in ("headline", "rule_days", "by_horizon", "by_tolerance", "sweeps", "products")}
    names = {"headline": ["strategy"], "rule_days": ["strategy"], "by_horizon": ["horizon", "strategy"], "by_tolerance": ["tolerance", "strategy"], "sweeps": ["sweep", "threshold"], "products": ["product_id", "strategy"]}
    shown = ["days", "drops", "buys", "waits", "neutrals", "hits", "buy_hits", "wait_hits"]
    rows = [t.select(F.lit(k).alias("section"), F.concat_ws(" ", *names[k]).alias("of_"), *shown) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


@query("A20_D08_by_reason")
def reasons(s, d):
    """How the rule's calls fared, by the reasons that they carry."""
    return backtest.report(_rule_days(s, d))["reasons"]


@query("A19_D08_policies")
def rule_policies(s, d):
    return backtest.report(_rule_days(s, d))["policies"].withColumn("mean_ratio", F.round("mean_ratio", 9))


@query(
    "A16_counts",
    with_("offers") + "select status, count(*) as offers, count(distinct product_id) as products from offers group by 1",
)
def counts(s, d):
    return model.offers(s, d).groupBy("status").agg(F.count("*").alias("offers"), F.count_distinct("product_id").alias("products"))


@query("D23_D24_backfill")
def backfilled(s, d):
    """A synthetic year for every offer without synthetic rows, ending the day before the earliest observation."""
    seen = model.observations(s, d)
    earliest = seen.agg(F.to_date(F.min("observed_at"))).first()[0] or date(1992, 1, 1)  # no observation: no rows either
    return backfill(missing(seen), earliest - timedelta(days=365), 365, 20251129)


@query("D10_D12_classifier")
def classified(s, d):
    """The trained alternative: learned on days whose horizon ends in the first three fifths, held out on the rest, against the rule there."""
    first, last = _span(s, d)
    days = (last - first).days + 1
    grid = _rule_days(s, d).withColumn("as_of", F.timestamp_micros(F.unix_micros(F.date_add(F.lit(first), F.col("day_idx") + 1).cast("timestamp")) - 1))
    rows = kept(features(backtest.scored(backtest.ahead(grid, backtest.HORIZON, backtest.TOLERANCE), backtest.WARMUP), F.col("sale_windows_n")), "examples")
    cut = days * 3 // 5
    learned, held = chronological(rows, "day_idx", cut, backtest.HORIZON)
    if learned.select("dropped").distinct().count() < 2:
        return backtest.tally(held.limit(0).withColumn("strategy", F.lit("")).withColumn("call", F.lit("")), ["strategy"]).select("strategy", "days", "drops", "buys", "waits", "neutrals", "hits")
    judged = train(learned)(held)
    calls = {"model": call(F.col("probability"), 0.5, 0.5), "abstaining": call(F.col("probability"), 0.35, 0.65), "rule": F.coalesce("signal", F.lit("neutral"))}
    each = F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("call")) for k, v in calls.items()))
    made = judged.withColumn("__c", F.explode(each)).select("dropped", "__c.*")
    return backtest.tally(made, ["strategy"]).select("strategy", "days", "drops", "buys", "waits", "neutrals", "hits")


@query("X20_keyboard_spec")
def keyboard(s, d):
    return model.read(s, d, "part").select("p_partkey", F.to_json(keyboard_spec(T.normalize_ascii(F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(" key")))))).alias("spec"))
