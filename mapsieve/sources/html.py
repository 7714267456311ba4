"""Pages of a crawled site: decoding, links, and places named in headings."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Encodings in the order in which they are tried.
PAGE_LADDER = ("shift_jis", "utf-8", "euc-jp", "iso-8859-1", "cp932", "windows-1252")
INDEX_LADDER = ("shift_jis", "cp932", "euc-jp", "iso-2022-jp", "utf-8")
_PLACE = "([^市区町村]+[市区町村])"


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes by the first encoding that fits, else UTF-8 without what does not fit."""

    def one(raw):
        for name in PAGE_LADDER:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", errors="ignore")

    return content.map(lambda raw: None if raw is None else one(bytes(raw)))


@F.pandas_udf(StringType())
def decoded_japanese(content: pd.Series) -> pd.Series:
    """Bytes by the first encoding that fits and gives kana, kanji or an html tag."""

    def one(raw):
        for name in INDEX_LADDER:
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            if "<html" in text.lower() or any("぀" <= ch <= "ヿ" or "一" <= ch <= "鿿" for ch in text):
                return text
        return raw.decode("shift_jis", errors="ignore")

    return content.map(lambda raw: None if raw is None else one(bytes(raw)))


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)])


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, text) of the links of pages (page_id, url, html)."""
    pattern = r"""(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>"""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("pos", "tag"))
    return found.select("page_id", "url", "pos", F.regexp_extract("tag", pattern, 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract("tag", pattern, 2), "<[^>]*>", "")).alias("text"))


def is_pdf_link(href: Column) -> Column:
    return href.endswith(".pdf")


def is_prefecture_link(href: Column) -> Column:
    return href.endswith("pref_frm.htm")


def is_city_link(href: Column) -> Column:
    return href.endswith("city_frm.htm") & ~href.startswith("http")


def is_page_link(href: Column) -> Column:
    """Frames that hold a page, but none of another year (r07 to h30)."""
    return href.endswith("fr.htm") & ~href.rlike("r0[1-7]|h30|h31")


def base_name(href: Column) -> Column:
    return F.element_at(F.split(href, "/"), -1)


def _inner(html: Column, tag: str) -> Column:
    return F.regexp_replace(F.regexp_extract(html, tag, 1), "<[^>]*>", "")


def place_of_page(html: Column) -> Column:
    """First city, ward, town or village named in the navigation, the title or the first heading; null without one."""
    sources = (r'(?is)<div[^>]*class="[^"]*navi__level[^"]*"[^>]*>(.*?)</div>', r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>")
    return F.coalesce(*(F.nullif(F.regexp_extract(_inner(html, s), _PLACE, 1), F.lit("")) for s in sources))


def with_ward(pages: DataFrame, wards: DataFrame) -> DataFrame:
    """Pages (page_id, city, navi) with the first ward (city, ward, ord) of their city that the navigation names."""
    hit = pages.join(wards, "city").filter(F.col("navi").contains(F.col("ward"))).groupBy("page_id").agg(F.min_by("ward", "ord").alias("district"))
    return pages.join(hit, "page_id", "left")


def url_map(df: DataFrame) -> DataFrame:
    """(year, prefecture, path) of a column mapping: map<year, map<prefecture, path>>."""
    return df.select(F.explode("mapping").alias("year", "m")).select("year", F.explode("m").alias("prefecture", "path"))


def task_list(pages: DataFrame) -> DataFrame:
    """(url, path) of all files that pages (page_id, url, html, prefecture, city, district) link to."""
    found = links(pages).filter(is_pdf_link(F.col("href"))).join(pages.select("page_id", "prefecture", "city", "district"), "page_id")
    return found.select(joined_url("url", "href").alias("file_url"), F.concat_ws("/", "prefecture", "city", F.nullif("district", F.lit("")), base_name(F.col("href"))).alias("path"))
