"""Resolution: listings and free text to catalog products, with scores that explain themselves.

Listings meet the products of their brand in a join and each pair is scored by itself, so neither side must fit a worker.
Texts meet names in a join of their token runs with the catalog's spellings; only texts with a hit are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sentiment import Lexicon
from tidemark.functions.text import Located, Sentences, contains_name, locate, normalize, normalized, spellings, touching

AUTO, REVIEW = 0.9, 0.4
#: What speaks against a match, and how much.
QUALIFIER, QUALIFIERS, LATE, LATE_AFTER, CONFLICT, NO_PRODUCT = 0.35, 2, 0.1, 4, 0.3, 0.5
OTHER_BRAND, UNSTATED = 0.35, 0.2


@dataclass(frozen=True)
class Product:
    product_id: int
    brand: str
    model: str
    aliases: tuple[str, ...] = ()
    spec: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Score:
    value: float
    reasons: tuple[str, ...] = ()
    start: int = -1
    end: int = -1


def _clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def outcome(score: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    return F.when(score >= auto, "auto").when(score >= review, "review").otherwise("none")


def score_listing(title: str, spec: dict, product: Product, siblings: set[str], identity: tuple[str, ...] = (), non_product: tuple[str, ...] = ()) -> Score:
    """How sure a normalised listing title is ``product``: where the model stands, less what speaks against it."""
    words = title.split()
    at = locate(words, product.model.split(), True)
    if at is None:
        return Score(0.0)
    minus, reasons = 0.0, [at.reason]

    def against(found: list, cost: float, why: str) -> None:
        nonlocal minus
        if found:
            minus += cost
            reasons.append(f"{why} {' '.join(map(str, found))}")

    beside = touching(words, at, siblings)
    against(beside, QUALIFIER * min(len(beside), QUALIFIERS), "sibling")
    if at.start > LATE_AFTER:
        against([at.start + 1], LATE, "late")
    own = dict(product.spec)
    against([f for f in identity if f in spec and f in own and str(spec[f]) != str(own[f])], CONFLICT, "conflict")
    against([p for p in map(normalize, non_product) if p and f" {p} " in f" {title} "], NO_PRODUCT, "no product")
    return Score(_clamp(at.base - minus), tuple(reasons), at.start, at.end)


class Catalog:
    """Products by brand, the tokens of each one's siblings, and the tokens of all brands."""

    def __init__(self, products: list[Product]):
        self.products = sorted(products, key=lambda p: p.product_id)
        self.blocks: dict[str, list[Product]] = {}
        for p in self.products:
            self.blocks.setdefault(p.brand, []).append(p)
        every = {b: {t for p in ps for t in p.model.split()} for b, ps in self.blocks.items()}
        self.siblings = {p.product_id: every[p.brand] - set(p.model.split()) for p in self.products}
        self.brand_words = {t for b in self.blocks for t in b.split()}

    def block(self, brand: str, title: str) -> list[Product]:
        """The brand's products; of an unknown brand, those of all brands that the title names."""
        if brand in self.blocks:
            return self.blocks[brand]
        return [p for b, ps in self.blocks.items() if b and f" {b} " in f" {title} " for p in ps]

    def resolve(self, brand: str, title: str, spec: dict, identity: tuple[str, ...] = (), non_product: tuple[str, ...] = ()) -> tuple[Product, Score] | None:
        """The best candidate: highest score, then the longer model, then the lesser id."""
        scored = [(p, score_listing(title, spec, p, self.siblings[p.product_id], identity, non_product)) for p in self.block(brand, title)]
        return min(scored, key=lambda x: (-x[1].value, -len(x[0].model), x[0].product_id), default=None)

    def score_mention(self, words: list[str], stated: set[str], product: Product) -> Score:
        """How sure a text means ``product``; its name must appear whole."""
        best: Located | None = None
        name = ""
        for candidate in (product.model, *product.aliases):
            at = locate(words, candidate.split(), False)
            if at and (best is None or at.end - at.start > best.end - best.start):
                best, name = at, candidate
        if best is None:
            return Score(0.0)
        reasons = [best.reason] + ([f"alias {name}"] if name != product.model else [])
        single, named = len(name.split()) == 1, product.brand in stated
        if single and not named and not any(c.isdecimal() for c in name):
            return Score(0.0, ("bare word without its brand",), best.start, best.end)
        minus = 0.0
        if beside := touching(words, best, self.siblings[product.product_id]):
            minus += QUALIFIER * min(len(beside), QUALIFIERS)
            reasons.append(f"sibling {' '.join(beside)}")
        if others := touching(words, best, self.brand_words - set(product.brand.split())):
            minus += OTHER_BRAND
            reasons.append(f"other brand {' '.join(others)}")
        if single and not named:
            minus += UNSTATED
            reasons.append("brand not named")
        return Score(_clamp(best.base - minus), tuple(reasons), best.start, best.end)

    def mentions(self, text: str, review: float = REVIEW) -> list[tuple[Product, Score]]:
        """Products that a text means; a span belongs to one product: the surer, then the longer span, then the longer model."""
        norm = normalize(text)
        words, stated = norm.split(), {b for b in self.blocks if b and f" {b} " in f" {norm} "}
        known = set(words) | {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, min(len(words), i + 5) + 1)}
        claims = []
        for p in self.products:
            if not any(n in known or n.split()[0] in known or "".join(n.split()) in known for n in (p.model, *p.aliases) if n):
                continue
            score = self.score_mention(words, stated, p)
            if score.start >= 0 and score.value >= review:
                claims.append((p, score))
        claims.sort(key=lambda x: (-x[1].value, x[1].start - x[1].end, -len(x[0].model), x[0].product_id))
        kept: list[tuple[Product, Score]] = []
        for p, s in claims:
            if all(s.end < k.start or k.end < s.start for _, k in kept):
                kept.append((p, s))
        return kept


def block_pairs(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(offer_id, product_id) pairs to score: equal brands; for listings of no known brand, brands that stand in their title.

    The second join compares titles with distinct brands only. Both sides have normalised brand, the listings title_norm.
    """
    brands = catalog.select("brand").distinct()
    known = listings.join(catalog.select("product_id", "brand"), "brand").select("offer_id", "product_id")
    other = listings.join(brands, "brand", "left_anti").select("offer_id", "title_norm")
    words = other.select("offer_id", "title_norm", F.explode(F.array_distinct(F.split("title_norm", " "))).alias("first"))
    named = words.join(brands.withColumn("first", F.split("brand", " ")[0]), "first").where(contains_name(F.col("title_norm"), F.col("brand")))
    return known.unionByName(named.select("offer_id", "brand").join(catalog.select("product_id", "brand"), "brand").select("offer_id", "product_id"))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """In as many partitions as shuffles have: few bytes, but much work a row for Python, so they are not to be put together by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def catalog_rows(spark: SparkSession, products: list[Product]) -> DataFrame:
    """The catalog as rows: product_id, brand, model, aliases, spec, siblings (tokens of its brand's other models)."""
    known = Catalog(products)
    rows = [(p.product_id, p.brand, p.model, list(p.aliases), dict(p.spec), sorted(known.siblings[p.product_id])) for p in known.products]
    return spark.createDataFrame(rows, "product_id long, brand string, model string, aliases array<string>, spec map<string,string>, siblings array<string>")


def resolve_listings(listings: DataFrame, products: list[Product], identity: tuple[str, ...] = (), non_product: tuple[str, ...] = ()) -> DataFrame:
    """offer_id, product_id, score, outcome, reasons. ``listings``: offer_id, brand, title, spec (map); offer_id is unique.

    The best candidate has the highest score, then the longer model, then the lesser id.
    """
    catalog = catalog_rows(listings.sparkSession, products)
    rows = listings.select("offer_id", normalized(F.coalesce("brand", F.lit(""))).alias("brand"), normalized(F.coalesce("title", F.lit(""))).alias("title_norm"), F.col("spec").alias("own"))
    pairs = _spread(block_pairs(rows, catalog).join(rows.drop("brand"), "offer_id").join(catalog, "product_id"), "offer_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                product = Product(r.product_id, r.brand, r.model, (), tuple(dict(r.spec).items()))
                score = score_listing(r.title_norm, dict(r.own or {}), product, set(r.siblings), identity, non_product)
                if score.value > 0:
                    out.append((r.offer_id, r.product_id, score.value, list(score.reasons), len(r.model)))
            yield pd.DataFrame(out, columns=["offer_id", "product_id", "score", "reasons", "size"])

    scored = pairs.mapInPandas(run, "offer_id long, product_id long, score double, reasons array<string>, size int")
    best = F.max_by(F.struct("product_id", "score", "reasons"), F.struct("score", "size", -F.col("product_id"))).alias("b")
    found = listings.select("offer_id").join(scored.groupBy("offer_id").agg(best), "offer_id", "left")
    score = F.coalesce("b.score", F.lit(0.0))
    return found.select("offer_id", "b.product_id", score.alias("score"), F.coalesce("b.reasons", F.array().cast("array<string>")).alias("reasons"), outcome(score).alias("outcome"))


def name_forms(products: list[Product]) -> list[tuple]:
    """Every spelling of every model and alias: form, its tokens, product, which name, whether it is written otherwise, name tokens, digits."""
    out = []
    for p in products:
        for k, name in enumerate((p.model, *p.aliases)):
            words = name.split()
            for otherwise, (_, run) in enumerate(spellings(words) if words else []):
                out.append((" ".join(run), len(run), p.product_id, k, otherwise, len(words), any(c.isdecimal() for c in name)))
    return out


def claims(texts: DataFrame, products: list[Product]) -> DataFrame:
    """Every product that a text may mean, before spans are shared out: mention_id, product_id, score, start and size of the span
    in tokens, phrase, model_size. ``texts`` has a unique mention_id and norm, the normalised text.

    A product counts with its longest name that stands in the text, of each name with its first place, written as it is before
    otherwise. Token runs of the lengths that the catalog's names and brands have are joined with them; nothing is nested.
    """
    spark = texts.sparkSession
    known = Catalog(products)
    forms = name_forms(known.products)
    brands = [b for b in known.blocks if b]
    if not forms:
        return texts.select("mention_id").where("false").selectExpr("mention_id", "0L product_id", "0D score", "0 start", "0 size", "'' phrase", "0 model_size")
    sizes = sorted({n for _, n, *_ in forms} | {len(b.split()) for b in brands})
    first = sorted({f[0].split()[0] for f in forms} | {b.split()[0] for b in brands})
    tokens_ = texts.select("mention_id", F.split("norm", " ").alias("t")).where("norm <> ''")
    at = lambda t, i: F.coalesce(F.get(t, i), F.lit(""))
    # only runs that begin as some name does leave the text
    spots = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get(F.col("t"), i).isin(first))
    runs = F.flatten(F.transform(spots, lambda i: F.array(*(F.struct(i.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice(F.col("t"), i + 1, n), " ").alias("form"), at(F.col("t"), i - 1).alias("left"), at(F.col("t"), i + n).alias("right")) for n in sizes))))
    grams = tokens_.select("mention_id", F.explode(runs).alias("r")).select("mention_id", "r.*")
    names = spark.createDataFrame(forms, "form string, size int, product_id long, name int, otherwise int, words int, digit boolean")
    hits = grams.join(names, ["form", "size"])
    stated = grams.join(spark.createDataFrame([(b, len(b.split())) for b in brands], "form string, size int"), ["form", "size"]).select("mention_id", F.col("form").alias("brand"), F.lit(True).alias("stated")).distinct()
    span = F.min(F.struct("otherwise", "start", "size", "left", "right", "words", "digit", "form")).alias("s")
    each = hits.groupBy("mention_id", "product_id", "name").agg(span)
    best = F.min(F.struct((-F.col("s.size")).alias("longest"), "name", "s")).alias("b")
    found = each.groupBy("mention_id", "product_id").agg(best).select("mention_id", "product_id", "b.s.*")
    dim = spark.createDataFrame([(p.product_id, p.brand, len(p.model), sorted(known.siblings[p.product_id]), p.brand.split()) for p in known.products], "product_id long, brand string, model_size int, siblings array<string>, own array<string>")
    rows = found.join(dim, "product_id").join(stated, ["mention_id", "brand"], "left")
    single, named = F.col("words") == 1, F.coalesce("stated", F.lit(False))
    beside = F.array_distinct(F.array("left", "right"))
    siblings = F.size(F.array_intersect(beside, "siblings"))
    others = F.exists(beside, lambda w: w.isin(sorted(known.brand_words)) & ~F.array_contains("own", w)) if known.brand_words else F.lit(False)
    minus = QUALIFIER * F.least(siblings, F.lit(QUALIFIERS)) + F.when(others, OTHER_BRAND).otherwise(0.0) + F.when(single & ~named, UNSTATED).otherwise(0.0)
    score = F.when(single & ~named & ~F.col("digit"), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - minus))
    return rows.select("mention_id", "product_id", score.alias("score"), "start", "size", F.col("form").alias("phrase"), "model_size")


def shared_out(found: DataFrame, review: float = REVIEW) -> DataFrame:
    """Claims of ``review`` or more such that no token counts for two products: the surer, then the longer span, the longer model, the lesser id.

    mention_id and said: an array of (score, start, size, phrase, product_id).
    """
    c = F.struct((-F.col("score")).alias("doubt"), (-F.col("size")).alias("longest"), (-F.col("model_size")).alias("model"), "product_id", "start", "size", "score", "phrase")
    ranked = found.where(F.col("score") >= review).groupBy("mention_id").agg(F.array_sort(F.collect_list(c)).alias("all"))
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["start"] + x["size"]) & (x["start"] < k["start"] + k["size"]))
    none = F.filter("all", lambda x: F.lit(False))
    return ranked.select("mention_id", F.aggregate("all", none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept)).alias("said"))


def find_mentions(texts: DataFrame, products: list[Product], lexicon: Lexicon = Lexicon(), most: int = 280) -> DataFrame:
    """mention_id, product_id, score, outcome, phrase, sentiment, sentiment_score, excerpt of every product that a text means."""
    rows = texts.select("mention_id", "text")
    said = shared_out(claims(rows.select("mention_id", normalized(F.coalesce("text", F.lit(""))).alias("norm")), products))
    hit = rows.join(said, "mention_id").select("mention_id", "text", F.transform("said", lambda x: F.struct(x["product_id"].alias("product_id"), x["score"].alias("score"), x["phrase"].alias("phrase"))).alias("said"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["mention_id", "product_id", "score", "phrase", "sentiment", "sentiment_score", "excerpt"]
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                sentences = Sentences(r.text)
                for s in r.said:
                    span = s["phrase"].split()
                    reading = lexicon.judge(sentences, span)
                    out.append((r.mention_id, s["product_id"], s["score"], s["phrase"], reading.sentiment, reading.score, sentences.excerpt(span, most)))
            yield pd.DataFrame(out, columns=names)

    schema = "mention_id long, product_id long, score double, phrase string, sentiment string, sentiment_score double, excerpt string"
    return _spread(hit, "mention_id").mapInPandas(run, schema).withColumn("outcome", outcome(F.col("score")))
