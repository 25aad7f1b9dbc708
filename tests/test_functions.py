from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetrail.functions import money as M
from pricetrail.functions import periods as P
from pricetrail.functions import text as X
from pricetrail.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,value",
    [("15.99lei", "15.99"), ("15,99 lei", "15.99"), ("101lei", "101.00"), ("1\xa0234,5 lei", "1234.50"), ("0lei", "0.00"),
     (" 1 234 567 LEI ", "1234567.00"), (None, None), ("", None)],
)
def test_good_prices(spark, text, value):
    got = one(spark, M.parse_price(F.lit(text).cast("string")))
    assert got["error"] is None and got["value"] == (Decimal(value) if value else None)


@pytest.mark.parametrize("text", ["-1lei", "NaNlei", "15.999lei", "1,234.56lei", "abc15lei", "10000000000lei", "lei", "12 34lei", "15"])
def test_bad_prices(spark, text):
    got = one(spark, M.parse_price(F.lit(text)))
    assert got["error"] and got["value"] is None


def test_discount_rounds_half_up(spark):
    dec = lambda v: F.lit(v).cast("decimal(12,2)")
    assert one(spark, M.discount_percent(dec("21.99"), dec("23.99"))) == Decimal("8.34")
    assert one(spark, M.discount_percent(dec("20"), dec("20"))) is None


@pytest.mark.parametrize(
    "raw,value",
    [(" 279905.0 ", "279905"), ("0000123", "0000123"), ("12.50", "12.50"), ("1e5", None), ("1.5E+3", None), ("a\tb", None), (" ", None), (None, None)],
)
def test_identifier_text(spark, raw, value):
    got = one(spark, X.identifier_text(F.lit(raw).cast("string")))
    assert got["value"] == value and (got["error"] is None) == (value is not None)


@pytest.mark.parametrize("number,mask,value", [(123.0, "00000", "00123"), (123.0, "0", "123"), (5.5, None, None), (-1.0, None, None), (1e15, None, None)])
def test_identifier_number(spark, number, mask, value):
    got = one(spark, X.identifier_number(F.lit(number), F.lit(mask) if mask else None))
    assert got["value"] == value and (got["error"] is None) == (value is not None)


def test_fold(spark):
    assert one(spark, X.fold(F.lit("   ȘTIUCĂ \t ţară ÎN  "))) == "stiuca tara in"


@pytest.mark.parametrize(
    "active,state,price,promo,old,want",
    [(True, "dated", 20, 10, 25, 10), (True, "observed", 20, None, 25, 20), (False, "dated", 47, 47, 54, 54), (False, "dated", 47, 47, None, None),
     (False, "observed", 20, 20, 25, 20), (False, None, 20, 10, 25, 20)],
)
def test_effective_price(spark, active, state, price, promo, old, want):
    cols = [F.lit(v).cast("int") for v in (price, promo, old)]
    assert one(spark, M.effective_price(F.lit(active), F.lit(state).cast("string"), *cols)) == want


@pytest.mark.parametrize(
    "kg,step,grams,price,old,unit,no_price,want",
    [("24.99", "12.49", "500", "12.49", None, None, False, "24.99"), ("24.99", "2.49", "100", "2.49", None, None, False, "24.99"),
     ("24.99", "6.24", "250", "6.24", None, None, False, "24.99"), ("24.99", "49.98", "2000", "49.98", None, None, False, "24.99"),
     ("3.99", "3.99", "1000", "3.99", "4.99", "Per KG", False, "3.99"), ("0", "0", "100", None, None, None, True, None),
     ("NaN", "12.49", "500", "12.49", None, None, False, "error"), ("-24.99", "12.49", "500", "12.49", None, None, False, "error"),
     ("2.499e1", "12.49", "500", "12.49", None, None, False, "error"), ("99.99", "12.49", "500", "12.49", None, None, False, "error"),
     ("24.99", "12.49", "0", "12.49", None, None, False, "error"), ("24.99", "12.50", "500", "12.49", None, None, False, "error"),
     ("3.99", "3.99", "1000", "3.99", "4.99", "buc", False, "error"), ("3.99", "3.99", "1000", "3.99", "2.99", "per kg", False, "error"),
     ("0", "0", "100", None, None, None, False, "error")],
)
def test_weight_price(spark, kg, step, grams, price, old, unit, no_price, want):
    dec = lambda v: F.lit(v).cast("decimal(12,2)")
    got = one(spark, M.weight_price(F.lit(kg), F.lit(step), F.lit(grams), dec(price), dec(old), F.lit(unit).cast("string"), F.lit(no_price)))
    if want == "error":
        assert got["error"] and not got["weighted"] and got["price"] is None
    else:
        assert got["error"] is None and got["weighted"] and got["price"] == (Decimal(want) if want else None)


@pytest.mark.parametrize(
    "text,start,end",
    [("Ofertă valabilă în perioada 1 octombrie 2026 – 14 octombrie 2026", "2026-09-30 21:00:00", "2026-10-14 20:59:59.999000"),
     ("01.12.2026 - 14/12/2026", "2026-11-30 22:00:00", "2026-12-14 21:59:59.999000"), ("14.12.2026 - 01.12.2026", None, None),
     ("1 mai 2026", None, None), ("31.02.2026 - 01.03.2026", None, None), ("", None, None)],
)
def test_period(spark, text, start, end):
    got = one(spark, P.promotion_period(F.lit(text), "Europe/Chisinau"))
    if start is None:
        assert got["error"]
    else:
        assert (str(got["starts_at"]), str(got["ends_at"]), got["error"]) == (start, end, None)


@pytest.mark.parametrize(
    "raw,want",
    [("/a/../b/?x=1#f", "https://shop.example/b/?x=1"), ("//shop.example/q", "https://shop.example/q"), ("x.html", "https://shop.example/x.html"),
     ("https://shop.example:443/p", "https://shop.example:443/p"), ("https://u@shop.example/p", None), ("http://shop.example/", None),
     ("https://shop.example.evil/p", None), ("https://shop.example:8443/p", None), ("javascript:1", None), ("/a/./b/..", "https://shop.example/a/")],
)
def test_public_url(spark, raw, want):
    assert one(spark, U.public_url(F.lit(raw), "shop.example")) == want


def test_openable_url(spark):
    good = {"https://www.shop.example/p": True, "https://shop.example/": False, "https://shop.example": False, "https://m.shop.example/p": False}
    assert {u: one(spark, U.openable_url(F.lit(u), "shop.example")) == u for u in good} == good


def test_thumbnails(spark):
    fits = lambda p: one(spark, U.suitable_thumbnail(F.lit("https://h" + p)))
    assert fits("/thumbnails/225/1/a.jpg") and not fits("/thumbnails/226/1/a.jpg") and not fits("/thumbnails/0/1/a.jpg") and not fits("/a.jpg")
