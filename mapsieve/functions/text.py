"""Text classification, cleaning and normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: First pattern that matches names the class.  (?U) makes \d and \w count all of Unicode.
STAGE5_RULES = (
    ("block_number", r"(?U)^\d{1,3}$"),
    ("route_price", r"(?U)^\d{1,4}[A-G]$"),
    ("complex_number", r"(?U)^\d{1,3}-\d{1,3}[A-G]?$"),
    ("price_with_unit", r"(?U)^\d{1,4}万?[A-G]?$"),
    ("reference_code", r"(?U)^[A-Z]\d{1,3}$"),
)
FORMAT_RULES = (
    ("block_number", r"(?U)^\d{1,3}$"),
    ("route_price", r"(?U)^\d{1,4}[A-G]$"),
    ("complex_address", r"(?U)^\d{1,3}-\d{1,3}[A-G]?$"),
    ("reference", r"(?U)^[A-Z]\d{1,3}$"),
    ("partial_number", r"(?U)^\d+$"),
    ("partial_letter", r"^[A-G]$"),
)
DOCUMENTED_RULES = (
    ("route_price", r"(?U)^\d{1,4}[A-G]$"),
    ("route_price_unit", r"(?U)^\d{1,4}万[A-G]?$"),
    ("block_number", r"(?U)^\d{1,3}$"),
    ("complex_address", r"(?U)^\d{1,3}-\d{1,3}$"),
    ("reference_mark", r"(?U)^[A-Z]\d{1,3}$"),
)
NUMBER_RULES = (r"(?U)^\d+[A-Z]?$", r"(?U)^\d+万$", r"(?U)^\d+千$", r"(?U)^\d+\.\d+$", r"(?U)^\d+,\d+$", r"(?U)^\d+[.,]\d+万$")
PRICE_RULES = NUMBER_RULES[:3]
FALLBACK_RULES = NUMBER_RULES[:4]
MEANINGFUL_RULES = (r"(?U)\d+[-ー]\d+", r"[町丁目番地号]", r"(?U)\d+[A-Z]", r"(?U)[東西南北].*\d", r"(?U)\d{2,}", r"[一二三四五六七八九十]+丁目")
ADDRESS_WORDS = ("丁目", "番地", "番", "号", "町", "区", "市", "府", "県", "丁", "地", "１", "２", "３", "４", "５", "６", "７", "８", "９", "０")
LABEL_WORDS = ("丁目", "番地", "号", "条", "町")
DIGIT_MAP = ("０１２３４５６７８９一二三四五六七八九－−‐‑‒", "0123456789123456789-----")
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県",
    "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県",
    "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
#: Characters that count as digits: decimal digits of all scripts, superscripts, subscripts and digits in circles or brackets.
_DIGITS = r"\p{Nd}¹²³⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"


def first_match(text: Column, rules, otherwise) -> Column:
    """Name of the first rule whose pattern is found in text."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def any_match(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def is_digit(text: Column) -> Column:
    return text.rlike(f"^[{_DIGITS}]+$")


def has_digit(text: Column) -> Column:
    return text.rlike(f"[{_DIGITS}]")


def stage5_type(text: Column, letters_any_length: bool = False) -> Column:
    """Class of a detection's text; letters_any_length: pure letters of any length have a class of their own."""
    letters = F.when(text.rlike(r"^\p{L}+$"), "pure_letter") if letters_any_length else F.when(text.rlike(r"^\p{L}$"), "single_letter")
    last = letters.when(text.rlike("[-/]"), "complex_identifier").otherwise("unknown")
    return first_match(text, STAGE5_RULES, F.when(is_digit(text), "pure_number").otherwise(last))


def format_type(text: Column) -> Column:
    return first_match(text, FORMAT_RULES, "invalid")


def documented_type(text: Column) -> Column:
    return first_match(text, DOCUMENTED_RULES, "unknown")


def is_price(text: Column) -> Column:
    return text.rlike(r"(?U)^\d{2,3}[A-G]$")


def vector_class(text: Column) -> Column:
    """address, district, price or other, of a text in a vector drawing."""
    return F.when(contains_any(text, LABEL_WORDS), "address").when((F.char_length(text) > 3) & ~has_digit(text), "district").when(is_price(text), "price").otherwise("other")


def boxed_class(text: Column, w: Column, h: Column) -> Column:
    """price, address, street or other, by text first and shape then."""
    price = text.rlike(r"(?U)^\d+[A-Z]$") | text.rlike(r"(?U)^\d{2,3}$")
    return F.when(price, "price").when(contains_any(text, ("市", "区", "町", "丁目")), "address").when(w > h * 3, "street").otherwise("other")


def _number_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w万千,.]", "")


def is_potential_number(text: Column) -> Column:
    t = _number_chars(text)
    return F.coalesce(t.rlike(r"(?U)\d") & (any_match(t, NUMBER_RULES) | (F.regexp_count(t, F.lit(r"(?U)\d")) / F.char_length(t) > 0.5)), F.lit(False))


def clean_number(text: Column) -> Column:
    """The text if it is a number, else its first digits with the first unit or capital; null without digits."""
    t = _number_chars(text)
    digits = F.regexp_extract(t, r"(?U)(\d+)", 1)
    return F.when(any_match(t, NUMBER_RULES), t).when(digits != "", F.concat(digits, F.regexp_extract(t, "([万千A-Z])", 1)))


def ocr_price(text: Column) -> Column:
    """A price after the usual misreadings are undone, or null."""
    t = F.translate(F.regexp_replace(text, r"\s", ""), "OoIlSGB", "0011568")
    return F.when(any_match(t, PRICE_RULES), t)


def is_fallback_price(text: Column) -> Column:
    return any_match(text, FALLBACK_RULES)


def geometry_class(w: Column, h: Column) -> Column:
    """numbers, japanese or mixed, by the shape of a text box."""
    ratio = w / h
    return F.when(ratio < 1.5, "japanese").when(ratio < 3, "numbers").otherwise("mixed")


def is_target(kind: Column) -> Column:
    return kind.isin("block_number", "route_price", "complex_number")


def is_meaningful(text: Column) -> Column:
    t = F.trim(text)
    return (F.char_length(t) >= 2) & (any_match(t, MEANINGFUL_RULES) | (F.regexp_count(t, F.lit("[一-鿿]")) >= 2))


def is_valid_address(text: Column) -> Column:
    return F.coalesce((F.char_length(F.trim(text)) >= 2) & (contains_any(text, ADDRESS_WORDS) | has_digit(text)), F.lit(False))


def is_numeric_query(text: Column) -> Column:
    return F.trim(text).rlike(r"(?U)^[\d①-⑩]+$")


def is_strict_circle(text: Column, kind: Column) -> Column:
    """A detection in a circle: up to four digits, a circled digit, or at most two characters with one outside Latin-1."""
    t = F.trim(text)
    return F.coalesce((kind == "circle") & (t.rlike(r"(?U)^\d{1,4}$") | t.rlike("^[①-⑩]$") | ((F.char_length(t) <= 2) & t.rlike("[^\\x00-\\x7f]"))), F.lit(False))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; the engine has no expression for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_digits(text: Column) -> Column:
    """Digits and dashes of all widths to ASCII, kanji digits one by one, white space collapsed."""
    t = F.replace(F.translate(text, *DIGIT_MAP), F.lit("十"), F.lit("10"))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_address(text: Column) -> Column:
    return normalize_digits(nfkc(F.coalesce(text, F.lit(""))))


def address_parts(text: Column) -> Column:
    """Struct chome, banchi, go, full_number of a normalised address; absent parts are null."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(part(r"(\d+)丁目").alias("chome"), part(r"(\d+)番地?").alias("banchi"), part(r"(\d+)号").alias("go"), part(r"(\d+[-‐]\d+[-‐]\d+)").alias("full_number"))


def sub_district(text: Column) -> Column:
    p = address_parts(text)
    joined = F.concat_ws("", F.concat(p["chome"], F.lit("丁目")), F.concat(p["banchi"], F.lit("番")), F.concat(p["go"], F.lit("号")), p["full_number"])
    return F.when(joined == "", text).otherwise(joined)


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9０-９一二三四五六七八九十①②③④⑤⑥⑦⑧⑨⑩]", "")


def fix_format(text: Column) -> Column:
    """Spaces and stray characters out, runs of three or more equal non-digits to one, last letter upper case."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s", ""), r"(?U)[^\w\-万千円]", "")
    t = F.regexp_replace(t, r"([^0-9])\1{2,}", "$1")
    return F.concat(F.substring(t, F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(0))), F.upper(F.right(t, F.lit(1))))


def fix_format_literal(text: Column) -> Column:
    """As fix_format, with runs of digits collapsed too."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s", ""), r"(?U)[^\w\-万千円]", "")
    t = F.regexp_replace(t, r"(.)\1{2,}", "$1")
    return F.concat(F.substring(t, F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(0))), F.upper(F.right(t, F.lit(1))))


#: Look-alikes by the side that a position of a price belongs to.
TO_DIGIT, TO_LETTER = ("OoIlSZBG", "00115286"), ("8640", "BGDO")


def correct_reading(text: Column) -> Column:
    """Undo look-alikes of a price or number: digits up to the last place, and a grade letter there if there was a letter."""
    body = F.substring(text, F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(0)))
    last = F.right(text, F.lit(1))
    looks = body.rlike("[0-9]") & text.rlike("^[0-9OoIlSZBG]+[0-9A-Z]?$")
    return F.when(looks, F.concat(F.translate(body, *TO_DIGIT), last)).otherwise(text)


def corrected(text: Column, confidence: Column) -> Column:
    """Struct text, original_text, was_corrected, confidence (5 % less after a correction)."""
    t = correct_reading(text)
    changed = t != text
    return F.struct(t.alias("text"), text.alias("original_text"), changed.alias("was_corrected"), F.when(changed, confidence * 0.95).otherwise(confidence).alias("confidence"))


def merge_texts(texts: Column, letters: str = "A-Z") -> Column:
    """Of an array of texts: the longest digits with the first letter of the class, or all joined."""
    digits = F.filter(texts, lambda t: t.rlike(r"(?U)^\d+$"))
    letter = F.filter(texts, lambda t: t.rlike(f"^[{letters}]$"))
    longest = F.aggregate(digits, F.lit(""), lambda a, b: F.when(F.char_length(b) > F.char_length(a), b).otherwise(a))
    return F.when((F.size(digits) > 0) & (F.size(letter) > 0), F.concat(longest, F.element_at(letter, 1))).otherwise(F.array_join(F.array_distinct(texts), ""))


def similarity_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def row_id(*columns: Column) -> Column:
    return F.md5(F.concat_ws("_", *columns))


def parse_address(query: str, cities: tuple[str, ...] = ()) -> dict[str, str]:
    """Prefecture, city and district of one address query; cities: those there are in the prefecture, in order."""
    query = query.strip()
    words = query.split()
    prefecture = next((p for p in PREFECTURES if p in query), "")
    city = next((x for x in cities if x in query), "") if prefecture else ""
    city = city or next((w for mark in "市区町村" for w in words if mark in w and w != prefecture), "")
    district = next((w for mark in ("丁目", "番地", "条", "段") for w in words if mark in w), "")
    if not district:
        rest = query
        for part in (prefecture, city):
            rest = rest.replace(part, "").strip() if part else rest
        district = rest
    return {"prefecture": prefecture, "city": city, "district": district}


def split_address(query: Column) -> Column:
    """Struct city, district: cut after the first 市; without one all is district."""
    at = F.instr(query, "市")
    return F.struct(F.when(at > 0, F.substring(query, F.lit(1), at)).otherwise("").alias("city"), F.when(at > 0, F.substring(query, at + 1, F.char_length(query))).otherwise(query).alias("district"))
