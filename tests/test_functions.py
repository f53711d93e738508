"""Scalar expressions on literal values."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as X


@pytest.mark.parametrize(
    "raw,parser,want",
    [
        ("O7", "small_integer", "7"),
        ("07", "short_integer", "7"),
        ("1.1", "level", "11"),
        ("123456789012345678", "battle_id_18", "123456789012345678"),
        ("52%", "percentage", "52"),
        ("9,8", "decimal", "9.8"),
        ("18:59", "duration", "18:59"),
        ("2026/08/01 19:45", "datetime", "2026-08-01 19:45"),
        ("08/01/202619:45:16", "datetime", "2026-08-01 19:45:16"),
        ("Victory", "result", "VICTORY"),
        ("16", "level", None),
        ("11123456789012345678", "battle_id_18", None),
        ("101%", "percentage", None),
        ("18:72", "duration", None),
        ("not a date", "datetime", None),
        ("2026-13-01 10:00", "datetime", None),
        ("5:07", "duration", "05:07"),
        ("", "level", None),
        (None, "level", None),
        ("0", "level", None),
        ("1.2.3", "decimal", None),
        ("0", "small_integer", "0"),
        ("  some   name ", "player_name", "some name"),
        ("x" * 65, "player_name", None),
        ("anything", "other", "anything"),
        ("１２％", "percentage", "12"),
        ("ＶＩＣＴＯＲＹ", "result", "VICTORY"),
        ("１８：５９", "duration", "18:59"),
        ("ｎａｍｅ\u3000ﬁx", "player_name", "name fix"),
        ("999999999999999999999", "large_integer", None),
        ("1,234", "large_integer", "1234"),
        ("000123", "large_integer", "123"),
        ("100%", "percentage", "100"),
        ("8.1", "duration", None),
        ("2026.1.2 3:04", "datetime", "2026-01-02 03:04"),
        ("1-2-2026 13:04:05", "datetime", "2026-01-02 13:04:05"),
        ("2026-02-30 10:00", "datetime", None),
        ("12345678", "battle_id", "12345678"),
        ("1234567", "battle_id", None),
        ("x", None, None),
    ],
)
def test_parsers(spark, raw, parser, want):
    df = spark.createDataFrame([(raw, parser)], "raw string, parser string")
    got = X.parse_readings(df, "raw", "parser").first()
    assert got["valid"] == (want is not None)
    assert got["value_str"] == want
    assert (len(got["messages"]) == 0) == got["valid"]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_messages(spark):
    def get(raw, parser):
        return X.parse_readings(spark.createDataFrame([(raw, parser)], "raw string, parser string"), "raw", "parser").first()["messages"][0]

    assert get("", "level") == "empty_ocr" and get("x", "level") == "integer_invalid" and get("99", "level") == "integer_out_of_range"
    assert get("18:72", "duration") == "duration_out_of_range" and get("1", "duration") == "duration_invalid"
    assert get("2026-02-30 10:00", "datetime") == "datetime_out_of_range" and get("draw", "result") == "result_unrecognized"


def test_text(spark):
    assert one(spark, X.normalize_label(F.lit("  Blade ’of—DESPAIR!! x_1"))) == "blade of despair x_1"
    assert one(spark, X.normalize_name(F.lit(" A.b-C d "))) == "abc d"
    said = {"foo (its bar) (should be baz qux)": "bar", "foo (should be A) (should be B.)": "B", "P (human proof: its C) (its D)": "D", "x (  ITS  y z ) w": "y z", "foo bar [sic] (unsure)": "foo bar", "[a] b [c]": "[a] b", "(unsure)": ""}
    assert {k: one(spark, X.reviewed_value(F.lit(k))) for k in said} == said
    assert one(spark, X.redact_url(F.lit("https://a.example/x;p?q=1#f"))) == "https://a.example/x"
    assert one(spark, X.redact_url(F.lit("https://a.example/x;p/y;q"))) == "https://a.example/x;p/y"
    assert one(spark, X.url_host(F.lit("HTTPS://A.Example:8080/x"))) == "a.example"
    assert one(spark, X.record_id(F.lit("s"), F.lit(None).cast("string"), F.lit(3))) == "s::3"
    ids = {("hero", "local", "hero:17", "x"): "hero_0017", ("hero", "local", "hero:123456", "x"): "hero_123456", ("hero", "a", "00017", "x"): "hero_0017", ("item", "a", "b:3", "Empty  SLOT"): "item_empty_slot"}
    for k in (("hero", "local", "17-x", "n"), ("item", "wiki", "b:3", "Blade")):
        ids[k] = f"{k[0]}_{uuid.uuid5(uuid.UUID('d8141574-300b-48fd-9676-a18202f8cd68'), ':'.join(k[:3])).hex[:12]}"
    assert {k: one(spark, X.stable_id(*map(F.lit, k))) for k in ids} == ids
    assert one(spark, X.framed_key("t", ab=F.lit("xyz"))) == hashlib.sha256(b"t\0" + b"\0\2ab" + (3).to_bytes(8, "big") + hashlib.sha256(b"xyz").digest()).hexdigest()
    assert one(spark, X.framed_key("t", ab=F.lit(""))) is None and one(spark, X.content_key(F.lit("a"), F.lit(""))) is None
    assert one(spark, X.content_key(F.lit("ab"), F.lit("c"))) != one(spark, X.content_key(F.lit("a"), F.lit("bc")))
    assert one(spark, X.nfkc(F.col("t")), t="Ａ①") == "A1"
    names = {"A b--c!": "a_b--c!", "X.O'Brien: <q>|\\/?*\"": "x.obrien_q"}
    assert {k: one(spark, X.safe_filename(F.lit(k))) for k in names} == names
    files = {"hero_017_some_name.png": ("hero", 17, "Some Name"), "hero_5_a1b-c.d.png": ("hero", 5, "A1B C D"), "item_Blade of Despair.png": ("item", None, "Blade of Despair"), "17_x.png": (None, None, None), "hero_x_y.png": (None, None, None)}
    assert {k: tuple(one(spark, X.filename_identity(F.lit(k)))) for k in files} == files
    ratings = {"12": 1.2, "205": None, "1.2.3": 1.2, "103": 10.3, "80": 8.0, "7": 7.0, "": None, ".": None, "20.0": 20.0, "20.1": None, "a 9.96 b": 10.0, "200": 20.0}
    assert {k: one(spark, X.rating_repair(F.lit(k))) for k in ratings} == ratings
    folded = {"STRASSE": "strasse", "Straße": "strasse", "ΣΑΣ": "σασ", "ıİ": "ıi̇", "ﬁx": "fix"}
    assert {k: one(spark, X.casefold(F.lit(k))) for k in folded} == {k: k.casefold() for k in folded} == folded
    fields = {("gold", "1 234"): ("total_gold", "int", None, 1234.0), ("total_gold_percent", "52% "): ("total_gold_percent", "int", None, 52.0), ("rating", "9.8"): ("rating", "float", None, 9.8), ("name", "A b"): ("player_name", "str", "A b", None), ("kills", "x"): ("kills", "invalid", None, None)}
    assert {k: tuple(one(spark, X.typed_field(*map(F.lit, k)))) for k in fields} == fields
    null = F.lit(None)
    out = [("bool", null, F.lit(1.0), "true"), ("int", null, F.lit(7.0), "7"), ("float", null, F.lit(7.0), "7.0"), ("str", F.lit("a"), null, "a"), ("none", null, null, "<UNKNOWN_OR_EMPTY>")]
    assert all(one(spark, X.export_text(F.lit(k), s.cast("string"), n.cast("double"))) == want for k, s, n, want in out)
    assert one(spark, X.url_title(F.lit("File:Añ o's.png"))) == "File%3AA%C3%B1%20o%27s.png"
    assert one(spark, X.corrected_digits(F.lit("OoIlSsBZ"))) == "00115582"
    assert one(spark, X.level_repair(F.lit("T4"))) == 14 and one(spark, X.level_repair(F.lit("73"))) == 13
    assert one(spark, X.holds_secret(F.lit("api_key = 'abcdefghijkl'"))) and not one(spark, X.holds_secret(F.lit("token passing")))


def test_numbers(spark):
    assert one(spark, N.ratio(F.lit(1.0), F.lit(0.0))) is None and one(spark, N.ratio_status(F.lit(0))) == "unavailable"
    assert [one(spark, N.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert one(spark, N.hamming64(N.from_hex64(F.lit("ffffffffffffffff")), F.lit(0).cast("long"))) == 64
    assert one(spark, N.aspect(F.lit(1920), F.lit(1080))) == "16:9"
    assert one(spark, N.mapped_correlation(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0)))) == 1.0
    assert one(spark, N.mapped_correlation(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(4.0)))) == 0.0
    box = F.struct(F.lit(-5).alias("x1"), F.lit(2).alias("y1"), F.lit(50).alias("x2"), F.lit(9).alias("y2"))
    assert one(spark, N.clip_box(box, F.lit(40), F.lit(40))).asDict() == {"x1": 0, "y1": 2, "x2": 40, "y2": 9, "changed": True}
    assert one(spark, N.clip_box(box, F.lit(40), F.lit(2))) is None
