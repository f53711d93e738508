"""Catalyst expressions for recognised text: repair, typed parsing, labels, addresses, ids.

Every function takes and gives columns; nothing here runs Python on a row, with the one
exception of ``nfkc`` (Spark has no Unicode compatibility normalisation).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the recognised formats.
DIGIT_REPAIR = ("OoIlS", "00115")
PARSERS = ("player_name", "battle_id", "battle_id_18", "result", "duration", "datetime", "level", "short_integer", "small_integer", "large_integer", "decimal", "percentage")
#: Look-alikes that the older engine corrects in numbers.
CORRECTIONS = ("OolISsBZ", "00115582")
#: Times as read: minutes and seconds; year first; month first.
CLOCK = r"(\d{1,2})\s*[:.]\s*(\d{2})"
ISO_TIME = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\s*(\d{1,2}:\d{2}(?::\d{2})?)"
US_TIME = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\s*(\d{1,2}:\d{2}(?::\d{2})?)"
#: What an export writes for no value.
NO_VALUE = "<UNKNOWN_OR_EMPTY>"
#: Fields of truth files by type, and their other names.
INT_FIELDS = ("assists", "consecutive_kills", "crowd_control", "damage_taken", "deaths", "enemy_kills", "healing_and_shields", "hero_damage", "jungle_gold", "kill_gold", "kills", "level", "minion_gold", "team_kills", "total_gold", "turret_damage")
PERCENT_FIELDS = ("crowd_control_percent", "damage_taken_percent", "healing_and_shields_percent", "hero_damage_percent", "jungle_gold_percent", "kill_gold_percent", "minion_gold_percent", "teamfight_participation", "total_gold_percent", "turret_damage_percent")
FIELD_ALIASES = {"hp_regen": "healing_and_shields", "hp_regen_percent": "healing_and_shields_percent", "gold": "total_gold", "name": "player_name"}
#: The name space of digests in stable ids.
ID_SPACE = "d8141574300b48fd9676a18202f8cd68"
#: Reviewers' corrections, the first kind before the second.
SAID = (r"(?i)\(\s*(?:human\s+proof\s*:\s*)?its\s+([^)]+)\s*\)", r"(?i)\(\s*should\s+be\s+([^)]+)\s*\)")
INTEGER_LIMIT = {"level": 15, "short_integer": 99, "small_integer": 99, "large_integer": 999_999}
SECRET_PATTERNS = (r"(?i)(authorization|cookie|api[_-]?key|access[_-]?token)\s*[:=]\s*['\"]?[A-Za-z0-9+/=_-]{12,}", r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{12,}")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def clean(text: Column) -> Column:
    """Trimmed, with runs of white space as one space (F1 without NFKC; see ``cleaned``)."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def cleaned(text: Column) -> Column:
    """Text in Unicode's compatible form, cleaned (F1).

    Only texts with a character beyond ASCII go through Python; the others are their own form.
    """
    return clean(F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text))


def numeric_text(text: Column, decimal: bool = False) -> Column:
    """Digits as read: look-alike letters repaired, the rest left out (F2)."""
    repaired = F.translate(F.translate(text, ",", ".") if decimal else F.translate(text, ",", ""), *DIGIT_REPAIR)
    return F.regexp_replace(repaired, "[^0-9.]" if decimal else "[^0-9]", "")


def corrected_digits(text: Column) -> Column:
    """Look-alike letters of the older engine as digits (F16)."""
    return F.translate(text, *CORRECTIONS)


def parse_readings(df: DataFrame, raw: str, parser: str) -> DataFrame:
    """df and what a raw reading says by its parser's rules (F3, F25, F26): value_type,
    value_str, value_num, valid, normalized, messages; a null parser is not parsed (P26).

    In stages, so that a text is cleaned once and each rule reads its own parser's rows
    only: a stage whose columns are read more than once is not inlined into the next.
    """
    own = df.columns
    kind, none = F.col(parser), F.lit(None)
    whole = kind.isin("battle_id", "battle_id_18", "percentage", *INTEGER_LIMIT)
    one = df.withColumn("_t", F.coalesce(cleaned(F.col(raw)), F.lit("")))
    t = F.col("_t")
    # Stage 2: the parts of a text that its parser asks for.
    dated = F.when(kind == "datetime", F.regexp_extract(t, ISO_TIME, 0))
    two = one.select(
        "*",
        F.when(whole, numeric_text(t)).alias("_digits"),
        F.when(kind == "decimal", numeric_text(t, decimal=True)).alias("_number"),
        F.when(kind == "result", F.regexp_replace(F.upper(t), "[^A-Z]", "")).alias("_letters"),
        F.when(kind == "duration", F.regexp_extract(t, CLOCK, 0)).alias("_clock"),
        F.when(dated != "", F.regexp_replace(dated, ISO_TIME, "$1-$2-$3 $4")).alias("_iso"),
        F.when(kind == "datetime", F.regexp_extract(t, US_TIME, 0)).alias("_us"),
    )
    # Stage 3: numbers and times.  Leading zeros go, so that any number of digits compares right.
    clock = F.split(F.regexp_replace("_clock", r"[^0-9:.]", ""), "[:.]")
    given = F.coalesce("_iso", F.when(F.col("_us") != "", F.regexp_replace("_us", US_TIME, "$3-$1-$2 $4")))
    three = two.select(
        *own, "_t", "_digits", "_number", "_letters",
        F.regexp_replace("_digits", "^0+(?=.)", "").alias("_stripped"),
        F.when(F.col("_letters").rlike("VICTORY|WIN"), "VICTORY").when(F.col("_letters").rlike("DEFEAT|LOSS|LOSE"), "DEFEAT").alias("_result"),
        F.when(F.col("_clock") != "", clock).alias("_minutes"),
        F.when((F.length(F.regexp_replace("_number", "[^.]", "")) <= 1) & ~F.col("_number").isin("", "."), F.col("_number").try_cast("double")).alias("_decimal"),
        given.alias("_given"),
    )
    day, time = F.split(F.split("_given", " ")[0], "-"), F.split(F.split("_given", " ")[1], ":")
    written = F.concat_ws(" ", F.concat_ws("-", day[0], F.lpad(day[1], 2, "0"), F.lpad(day[2], 2, "0")), F.concat_ws(":", F.lpad(time[0], 2, "0"), F.array_join(F.slice(time, 2, 2), ":")))
    four = three.withColumn("_written", F.when(F.col("_given").isNotNull(), written))
    stamp = F.try_to_timestamp(F.when(F.length("_written") == 16, F.concat("_written", F.lit(":00"))).otherwise(F.col("_written")), F.lit("yyyy-MM-dd HH:mm:ss"))
    limit = F.lit(None).cast("int")
    for name, most in INTEGER_LIMIT.items():
        limit = F.when(kind == name, F.lit(most)).otherwise(limit)
    limit = F.when(kind == "percentage", F.lit(100)).otherwise(limit)
    number = F.when(F.length("_stripped").between(1, 9), F.col("_stripped").cast("int"))
    five = four.select(
        *own, "_t", "_digits", "_number", "_letters", "_stripped", "_result", "_minutes", "_decimal", "_given", "_written",
        F.when(number <= limit, number).alias("_int"), stamp.isNotNull().alias("_dated"),
        F.when(F.col("_minutes")[1].cast("int") <= 59, F.concat_ws(":", F.lpad(F.col("_minutes")[0], 2, "0"), F.col("_minutes")[1])).alias("_mmss"),
    )
    integer, digits, stripped = kind.isin(*INTEGER_LIMIT), F.col("_digits"), F.col("_stripped")
    long = F.length("_digits")
    # What each parser's rule gives: type, valid, text, number, normalized, message.
    rules = [
        (t == "", "none", F.lit(False), None, None, F.lit(""), "empty_ocr"),
        (kind.isNull(), "none", F.lit(False), None, None, t, "semantic field has no OCR parser"),
        (kind == "player_name", "str", F.length(t) <= 64, t, None, t, "player_name_length_invalid"),
        (kind.isin("battle_id", "battle_id_18"), "str", F.when(kind == "battle_id_18", long == 18).otherwise(long.between(8, 32)), digits, None, digits, "battle_id_invalid"),
        (kind == "result", "str", F.col("_result").isNotNull(), F.col("_result"), None, F.col("_letters"), "result_unrecognized"),
        (kind == "duration", "str", F.col("_mmss").isNotNull(), F.col("_mmss"), None, F.coalesce("_mmss", t), F.when(F.col("_minutes").isNull(), "duration_invalid").otherwise("duration_out_of_range")),
        (kind == "datetime", "str", F.col("_dated"), F.col("_written"), None, F.when(F.col("_dated"), F.col("_written")).otherwise(F.coalesce("_given", t)), F.when(F.col("_given").isNull(), "datetime_invalid").otherwise("datetime_out_of_range")),
        (integer, "int", F.col("_int").isNotNull() & ((kind != "level") | (F.col("_int") >= 1)), stripped, F.col("_int"), stripped, F.when(digits == "", "integer_invalid").otherwise("integer_out_of_range")),
        (kind == "decimal", "float", F.coalesce(F.col("_decimal").between(0, 100), F.lit(False)), F.col("_number"), F.col("_decimal"), F.col("_number"), F.when(F.col("_decimal").isNull(), "decimal_invalid").otherwise("decimal_out_of_range")),
        (kind == "percentage", "int", F.col("_int").isNotNull(), stripped, F.col("_int"), F.when(digits == "", digits).otherwise(F.concat(stripped, F.lit("%"))), F.when(digits == "", "percentage_invalid").otherwise("percentage_out_of_range")),
    ]

    def chosen(at: int, otherwise) -> Column:
        out = None
        for rule in rules:
            value = rule[at] if rule[at] is not None else none
            value = F.lit(value) if isinstance(value, str) else value
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out.otherwise(otherwise)

    six = five.select(*own, chosen(1, F.lit("str")).alias("value_type"), F.coalesce(chosen(2, F.lit(True)), F.lit(False)).alias("valid"), chosen(3, t).cast("string").alias("_s"), chosen(4, none).cast("double").alias("_n"), chosen(5, t).alias("normalized"), chosen(6, none).cast("string").alias("_m"))
    valid = F.col("valid")
    return six.select(*own, "value_type", F.when(valid, F.col("_s")).alias("value_str"), F.when(valid, F.col("_n")).alias("value_num"), "valid", "normalized", F.when(valid, F.array().cast("array<string>")).otherwise(F.array("_m")).alias("messages"))


def casefold(text: Column) -> Column:
    """Letters without case: through upper case, so that sharp s is ss; final sigma as any other."""
    kept = F.translate(text, "\u0131", "\ue000")  # dotless i has no other case
    return F.translate(F.lower(F.upper(kept)), "\u03c2\ue000", "\u03c3\u0131")


def normalize_label(text: Column) -> Column:
    """Without case, typographic apostrophes plain, non-word characters as single spaces."""
    return F.trim(F.regexp_replace(F.translate(casefold(text), "’", "'"), r"(?U)[^\w]+", " "))


def normalize_name(text: Column) -> Column:
    """Lowered, without punctuation, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def reviewed_value(text: Column) -> Column:
    """What a reviewer says a value is (F6): the last ``(its X)``, also ``(human proof: its X)``;
    without one the last ``(should be X)``, both without closing points; else the text before
    a bracket, without a ``[..]`` at its end."""
    last = [F.try_element_at(F.regexp_extract_all(text, F.lit(p), 1), F.lit(-1)) for p in SAID]
    last = [F.regexp_replace(F.trim(x), "[.)]+$", "") for x in last]
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, r"^([^(]*)", 1)), r"\s*\[[^\]]*\]\s*$", ""))
    return F.coalesce(*last, plain)


def typed_edit(text: Column, value_type: Column) -> Column:
    """An edited value by the type of what was predicted (F8): value_type, value_str, value_num."""
    low = F.lower(F.trim(text))
    none = low.isin("", "none", "null", "-")
    truth = F.when(low.isin("true", "yes", "1"), F.lit(1.0)).when(low.isin("false", "no", "0"), F.lit(0.0))
    number = F.regexp_replace(low, ",", "").try_cast("double")
    num = F.when(value_type == "bool", truth).when(value_type.isin("int", "float"), number)
    ok = ~none & ((value_type == "str") | num.isNotNull())
    return F.struct(F.when(ok, value_type).otherwise(F.lit("none")).alias("value_type"), F.when(ok & (value_type == "str"), F.trim(text)).alias("value_str"), F.when(ok, num).alias("value_num"))


def holds_secret(text: Column) -> Column:
    """Whether a text shows a credential."""
    return text.rlike(SECRET_PATTERNS[0]) | text.rlike(SECRET_PATTERNS[1])


def redact_url(url: Column) -> Column:
    """The address without the last path part's parameters, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "(?s)[?#].*$", ""), ";[^/]*$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def safe_filename(name: Column) -> Column:
    """Lowered, without characters that file systems refuse and apostrophes, blanks as underscores."""
    return F.lower(F.translate(F.translate(F.regexp_replace(name, r'[<>:"/\\|?*]', ""), " ", "_"), "'", ""))


def titled(text: Column) -> Column:
    """Every run of letters with a capital first letter, also after a digit or a mark."""
    mark = "\ue001"
    apart = F.regexp_replace(text, r"(?U)([^\p{L}\s])(?=\p{L})", f"$1{mark} ")
    return F.regexp_replace(F.initcap(apart), f"{mark} ", "")


def filename_identity(name: Column) -> Column:
    """(kind, number, title) of ``hero_17_some_name.png`` and ``item_Some Name.png``, nulls of
    any other name (F10)."""
    hero, item = r"^hero_(\d+)_([A-Za-z0-9_.-]+)\.png$", r"(?s)^item_(.+)\.png$"
    is_hero, is_item = name.rlike(hero), name.rlike(item)
    words = F.translate(F.regexp_extract(name, hero, 2), "_-.", "   ")
    return F.struct(
        F.when(is_hero, "hero").when(is_item, "item").alias("kind"),
        F.when(is_hero, F.regexp_extract(name, hero, 1).try_cast("int")).alias("number"),
        F.when(is_hero, titled(words)).when(is_item, F.regexp_extract(name, item, 1)).alias("title"),
    )


def record_id(*parts: Column) -> Column:
    """Colon-joined identity of a record, nulls as empty."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_key(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two lists of parts collide; null where
    a part is null or empty, which no content is (F21)."""
    given = [F.when(F.octet_length(x.cast("string")) > 0, x.cast("string")) for x in parts]
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in given]), 256)


def framed_key(tag: str, **contents: Column) -> Column:
    """SHA-256 over a tag and, in order, each role's name (two bytes of length before it) and
    its content's length (eight bytes) and digest; null where a content is null or empty (F21)."""
    def number(n: Column, width: int) -> Column:
        return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))

    parts = [F.concat(F.lit(tag), F.lit("\0")).cast("binary")]
    for role, content in contents.items():
        raw = F.when(F.octet_length(content) > 0, content.cast("binary"))
        parts += [number(F.lit(len(role)), 2), F.lit(role).cast("binary"), number(F.octet_length(raw), 8), F.unhex(F.sha2(raw, 256))]
    return F.sha2(F.concat(*parts), 256)


def numbered_id(kind: Column | str, number: Column) -> Column:
    """``kind_`` and the number, at least four digits of it."""
    text = F.regexp_replace(number.cast("string"), "^0+(?=.)", "")
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("_"), F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0")))


def stable_id(kind: Column, adapter: Column, identity: Column, name: Column) -> Column:
    """A record's id before repeats are told apart (F20): heroes by the number after the last
    colon of their identity, the empty item slot by its name, others by twelve digits of a
    name-based UUID of kind, adapter and identity (its version stands behind these digits)."""
    tail = F.substring_index(identity, ":", -1)
    framed = F.concat(F.unhex(F.lit(ID_SPACE)), F.concat_ws(":", kind, adapter, identity).cast("binary"))
    digest = F.concat(kind, F.lit("_"), F.substring(F.sha1(framed), 1, 12))
    by_number = (kind == "hero") & tail.rlike("^[0-9]+$")
    return F.when(by_number, numbered_id(kind, tail)).when((kind == "item") & (normalize_label(name) == "empty slot"), F.lit("item_empty_slot")).otherwise(digest)


def level_repair(text: Column) -> Column:
    """Level readings whose leading 1 was misread (F15, A30): 41-45 and 71-75 become 11-15."""
    n = F.regexp_replace(F.translate(text, "TtIlgL", "111111"), "[^0-9]", "").try_cast("int")
    return F.when(n.between(41, 45), n - 30).when(n.between(71, 75), n - 60).otherwise(n)


def rating_repair(text: Column) -> Column:
    """Ratings read without their point (F15): digits alone, two or more, get one before the
    last; further points go; over 20 is none; one decimal (ties of the decimal text to even)."""
    kept = F.regexp_replace(text, "[^0-9.]", "")
    first = F.substring_index(kept, ".", 1)
    rest = F.translate(F.substring(kept, F.length(first) + 2, F.length(kept)), ".", "")
    pointed = F.when(kept.contains("."), F.concat(first, F.lit("."), rest)).when(F.length(kept) >= 2, F.regexp_replace(kept, "(.)$", ".$1")).otherwise(kept)
    value = pointed.try_cast("double")
    return F.when(value.between(0, 20), F.bround(value, 1))


def typed_field(field: Column, text: Column) -> Column:
    """A truth text by its field's name, aliases resolved (F7): field, value_type, value_str,
    value_num; the type is ``invalid`` where a number is asked for and none is given."""
    name = F.coalesce(*[F.when(field == old, new) for old, new in FIELD_ALIASES.items()], field)
    whole, part, real = name.isin(*INT_FIELDS), name.isin(*PERCENT_FIELDS), name == "rating"
    digits = F.when(whole, F.replace(text, F.lit(" "))).when(part, F.regexp_replace(text, "[% ]+$", ""))
    number = F.when(whole | part, F.when(F.trim(digits).rlike("^[+-]?[0-9]+$"), F.trim(digits).try_cast("double"))).when(real, text.try_cast("double"))
    kind = F.when(whole | part, "int").when(real, "float").otherwise("str")
    ok = (kind == "str") | number.isNotNull()
    return F.struct(name.alias("field"), F.when(ok, kind).otherwise("invalid").alias("value_type"), F.when(kind == "str", text).alias("value_str"), number.alias("value_num"))


def export_text(value_type: Column, value_str: Column, value_num: Column) -> Column:
    """A value as an export writes it (F9); a mark of its own for none."""
    return (
        F.when(value_type == "bool", F.when(value_num == 1, "true").otherwise("false"))
        .when(value_type == "int", value_num.cast("long").cast("string"))
        .when(value_type == "float", value_num.cast("string"))
        .when(value_type.isin("str", "json"), value_str)
        .otherwise(NO_VALUE)
    )


def url_title(title: Column) -> Column:
    """A page title as part of an address: blanks as ``%20``."""
    return F.replace(F.url_encode(title), F.lit("+"), F.lit("%20"))
