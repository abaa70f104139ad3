import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import hooks


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_keywords(spark):
    found = value(spark, X.keywords(F.col("t")), t="The AMS1117 gives 1A; MIN 3.3V MAX 1.8 V, 5 mV and 2 µA. I2C, usb, sot-223 DC IC")
    assert {"AMS1117", "1A", "3.3V", "1.8V", "5MV", "2uA", "I2C", "USB", "SOT-223"} <= set(found)
    assert not {"MIN", "MAX", "DC", "IC"} & set(found)
    assert found == sorted(found, key=lambda k: (-len(k), k))
    many = " ".join(f"TPS{10000 + i}" for i in range(100))
    assert len(value(spark, X.keywords(F.col("t")), t=many)) == 50


def test_nets(spark):
    text = "IFACE_SCL PREF__SDA NLIFACE0D0 GND U12\nDISPLAY&SENSOR\nAB\nTITLE\nPOWER INPUT"
    assert value(spark, X.nets(F.col("t")), t=text) == ["GND", "IFACE_D0", "IFACE_SCL", "PREF_SDA"]
    assert value(spark, X.module_labels(F.col("t")), t=text) == ["DISPLAY&SENSOR", "POWER INPUT"]


def test_module_nets_stay_apart(spark):
    text = "LCD & TOUCH\nLCD_D0 LCD_SCL\nAUDIO & MIC\nAUD_CLK GND"
    zones = X.module_zones(X.module_labels(F.col("t")), X.nets(F.col("t")), F.col("t"))
    assert [(z.label, z.nets) for z in value(spark, zones, t=text)] == [("LCD & TOUCH", ["LCD_D0", "LCD_SCL"]), ("AUDIO & MIC", ["AUD_CLK", "GND"])]


@pytest.mark.parametrize(("seconds", "want"), [(3.21, "3.2 秒"), (65.0, "1 分 5.0 秒"), (-1.0, "0.0 秒")])
def test_elapsed(spark, seconds, want):
    assert value(spark, X.elapsed(F.lit(seconds))) == want


@pytest.mark.parametrize(("text", "want"), [("电源接口", "eng+chi_sim"), ("plain words", "eng"), ("", "eng")])
def test_ocr_language(spark, text, want):
    assert value(spark, X.ocr_language(F.lit(text))) == want


def test_slug_keeps_other_scripts(spark):
    assert value(spark, X.slug(F.lit(" 电源 Power (v2) "))) == "电源-power-v2"


def test_fact_match_ignores_blanks_and_case(spark):
    assert value(spark, X.fact_in(F.lit("1.2 a"), F.lit("draws 1.2A at most")))
    assert not value(spark, X.fact_in(F.lit("  "), F.lit("anything")))


@pytest.mark.parametrize(("path", "want"), [("../images/a.png", "p/images/a.png"), ("../../../x.png", None), ("./b.png", "p/b1/b.png"), ("https://e/x.png", "https://e/x.png"), ("#top", None)])
def test_asset_paths_stay_inside(spark, path, want):
    assert value(spark, X.asset_path(F.lit("p/b1"), F.lit(path))) == want


def test_rewrite_heuristic(spark):
    assert value(spark, X.needs_rewrite(F.lit("and what about this one over there, please?"), F.lit(True)))
    assert not value(spark, X.needs_rewrite(F.lit("x" * 70), F.lit(True)))
    assert not value(spark, X.needs_rewrite(F.lit("this"), F.lit(False)))


def test_excerpt_finds_the_densest_window():
    text = "a" * 600 + " pin " + "b" * 600 + " pin lcd " + "c" * 600
    assert "pin lcd" in hooks.excerpt_of(text, ["pin", "lcd"])
    assert hooks.excerpt_of(text, ["none"]) == text[:512]
    assert hooks.excerpt_of("short", ["pin"]) == "short"
    assert len(hooks.excerpt_of("ß" * 900 + "pin", ["pin"])) <= 512
