from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.sentiment import Lexicon
from tidemark.operators.resolve import Catalog, Product, score_listing


@pytest.mark.parametrize(
    ("title", "model", "siblings", "score"),
    [
        ("keychron q6 he qmk wireless custom keyboard", "q6 he", "", 1.0),
        ("keychron q65 custom keyboard", "q6", "", 0.0),
        ("epomaker hack 70 ortholinear keyboard", "hack70", "", 1.0),
        ("keychron q1pro keyboard", "q1 pro", "", 1.0),
        ("kbdfans kbd67 r1 lite barebones diy keyboard kit", "kbd67 lite", "", 0.8),
        ("ducky one 2 mini pure white", "one 2 mini pro", "", 0.6 * 4 / 5),
        ("ducky one 3 sf classic", "one 2 sf", "", 0.6 * 0.5 * 0.3),
        ("keychron q2 he 8k", "q2", "he max pro ultra", 0.65),
        ("keychron pro q2 max he ultra", "q2", "pro max he ultra", 0.30),
        ("case and plate set for the varmilo minilo vxt67", "minilo vxt67", "", 0.9),
    ],
)
def test_listing_score(title, model, siblings, score):
    assert score_listing(title, {}, Product(1, "b", model), set(siblings.split())).value == pytest.approx(score)


def test_listing_conflicts():
    product = Product(1, "keychron", "q1 pro", spec=(("layout_size", "75"),))
    assert score_listing("keychron q1 pro", {"layout_size": "65"}, product, set(), ("layout_size",)).value == pytest.approx(0.7)
    assert score_listing("athena 75 with pbtfans fairy r2", {}, Product(1, "a", "athena 75"), set(), (), ("with PBTfans",)).value == pytest.approx(0.5)


def test_mentions_by_joins_are_those_by_loops(spark):
    """The joined form against the catalog's own loop over all products, on texts with every spelling and neighbour."""
    from tidemark.operators.resolve import claims, find_mentions, shared_out

    products = [Product(1, "keychron", "q15 max"), Product(2, "hhkb", "studio"), Product(3, "glorious", "gmmk pro"), Product(4, "wooting", "60he"), Product(5, "keychron", "q15"), Product(6, "keychron", "k2 he pro", ("kay two",)), Product(7, "", "th80")]
    texts = ["Just got my Keychron Q15 Max and love it", "my studio is quiet", "HHKB Studio", "gmmk pro is heavy", "keychron gmmk pro clone", "the gmmk pro or the q15 max", "q15max vs 60 he, no regrets!", "k2hepro", "kay two pro of keychron", "Q15. Pro q15", "", None, "the th80 hhkb", "q 15 keychron max"]
    df = spark.createDataFrame(list(enumerate(texts)), "mention_id long, text string")
    catalog = Catalog(products)
    want = {(i, p.product_id, round(s.value, 9), s.start, s.end - s.start + 1) for i, t in enumerate(texts) for p, s in catalog.mentions(t or "")}
    norm = df.select("mention_id", T.normalized(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = shared_out(claims(norm, products)).select("mention_id", F.explode("said").alias("s")).select("mention_id", "s.*").collect()
    assert {(r.mention_id, r.product_id, round(r.score, 9), r.start, r.size) for r in rows} == want
    said = {(r.mention_id, r.product_id): r for r in find_mentions(df, products).collect()}
    assert said[0, 1].sentiment == "positive" and said[0, 1].excerpt == texts[0] and len(said) == len(want)
    assert find_mentions(df, []).count() == 0


def test_mentions():
    catalog = Catalog([Product(1, "keychron", "q15 max"), Product(2, "hhkb", "studio"), Product(3, "glorious", "gmmk pro"), Product(4, "wooting", "60he")])
    found = lambda t: [(p.product_id, s.value) for p, s in catalog.mentions(t)]
    assert found("Just got my Keychron Q15 Max and love it") == [(1, 1.0)]
    assert found("my studio is quiet") == [] and found("HHKB Studio") == [(2, 1.0)]
    assert found("gmmk pro is heavy") == [(3, 1.0)]
    assert found("keychron gmmk pro clone") == [(3, pytest.approx(0.65))]
    assert {p for p, _ in found("the gmmk pro or the q15 max")} == {1, 3}


@pytest.mark.parametrize(
    ("text", "sentiment"),
    [
        ("Is the q1 pro any good?", "neutral"),
        ("This is a step up from the q1 pro.", "negative"),
        ("You can't really go wrong with the q1 pro.", "positive"),
        ("Bought the q1 pro, no regrets.", "positive"),
        ("The q1 pro is terrible", "negative"),
        ("Great day. Nothing here. I have the q1 pro", "neutral"),
    ],
)
def test_sentiment(text, sentiment):
    assert Lexicon().read(text, ["q1", "pro"]).sentiment == sentiment


def test_rank_and_money(spark):
    rows = spark.createDataFrame([("1. Keychron Q1 Pro\n2. other", "q1 pro"), ("my #2 is the q1 pro", "q1 pro"), ("2 q1 pro boards", "q1 pro"), ("number 3: q1 pro", "q1 pro"), (None, "q1 pro"), ("#1 q1 pro", "")], "t string, n string")
    assert [r[0] for r in rows.select(T.ranks(F.col("t"), F.col("n"))).collect()] == [1, 2, None, 3, None, None]
    many = "My top 5 for 2026:\n1. Keychron Q1 Pro\n2) Glorious GMMK Pro\n#3 KBDfans Athena 75\nnumber 4: Wooting 60HE V2"
    assert [T.rank(many, n.split()) for n in ("q1 pro", "gmmk pro", "athena 75", "60he v2")] == [1, 2, 3, 4]
    for text, name in (("I bought 2 Epomaker P65 on Amazon", "epomaker p65"), ("5. Keychron K2 Ultra 4. Epomaker TH80", "th80"), ("top 5 keyboards: the Q1 Pro", "q1 pro"), ("#1 Q15 Max", "q1"), ("1. a b c q1", "q1"), ("no. 2\na\nq1", "q1")):
        assert T.rank(text, name.split()) is None, text
    assert T.rank("ranked 7 — the big q1", ["q1"]) == 7 and T.rank("no.2 q1", ["q1"]) == 2
    money = spark.createDataFrame([("12.345",), ("-1",), ("abc",), (None,)], "t string").select(T.to_cents(F.col("t"))).collect()
    assert [m[0] for m in money] == [1235, None, None, None]


def test_normalize_and_excerpt():
    assert T.normalize("Müller–Straße №5 ﬁne") == "muller straße no5 fine" and T.normalize(None) == ""
    assert T.excerpt("One. The q1 pro is fine. Three.", ["q1", "pro"], 30) == "The q1 pro is fine. Three."


def test_store_variants(spark):
    from tidemark.sources.stores import variants

    body = '{"products":[{"title":"Q1","handle":"q1","vendor":"K","tags":["a"],"product_type":"kb","variants":[{"id":1,"title":"Default Title","sku":" ","price":"99.90"},{"id":2,"title":"Red","sku":"s","price":"0.00","available":true}]}]}'
    rows = variants(spark.createDataFrame([(body,)], "body string"), "https://x.example").collect()
    assert [(r.title, r.url, r.sku, r.price_cents, r.in_stock) for r in rows] == [("Q1", "https://x.example/products/q1?variant=1", None, 9990, False)]
