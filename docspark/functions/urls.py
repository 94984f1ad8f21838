"""Functions on URLs."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docspark.config import Settings
from docspark.functions.text import alternation, squeeze, strip


def is_pdf(url: Column) -> Column:
    return F.regexp_replace(F.split_part(F.lower(url), F.lit("?"), F.lit(1)), "/+$", "").endswith(".pdf")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def same_domain(a: Column, b: Column) -> Column:
    return authority(a) == authority(b)


def local_name(url: Column) -> Column:
    """Eight digits of the hash, and the last part of the path in safe characters."""
    last = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)/*$", 1)
    safe = F.substring(F.regexp_replace(last, "(?U)[^\\w\\-.]", "_"), 1, 80)
    return F.concat(F.substring(F.md5(url), 1, 8), F.lit("_"), F.when(safe != "", safe).otherwise("document"))


@F.pandas_udf(StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link, strict=True)])


def resolve(base: Column, link: Column) -> Column:
    """The absolute form of a link: blanks escaped, no fragment, no slash at the end; null unless it is http."""
    simple = F.when(link.rlike("^https?://"), link).when(
        link.rlike("^/(?!/)"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), link)
    )
    # Python sees null where it has nothing to do.
    other = simple.isNull() & link.isNotNull()
    whole = F.coalesce(simple, _joined(F.when(other, base), F.when(other, link)))
    clean = F.regexp_replace(F.split_part(F.replace(strip(whole), F.lit(" "), F.lit("%20")), F.lit("#"), F.lit(1)), "/+$", "")
    return F.when(clean.startswith("http"), clean)


def clean_name(label: Column, url: Column, prefix: str = "", settings: Settings = Settings()) -> Column:
    """The label of a link, or, where it says nothing (has four characters or less, only signs and digits or only words of
    navigation), a name from its URL."""
    text = strip(F.regexp_replace(strip(F.coalesce(label, F.lit(""))), "(?i)\\s*\\(pdf,?\\s*[\\d.]+\\s*[km]b\\)\\s*$", ""))
    generic = (
        (F.length(text) <= 4)
        | F.forall(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), 1), lambda w: w.isin(*settings.generic_words))
        | text.rlike("(?U)^[\\W\\d]+$")
        | text.rlike("(?i)" + alternation(settings.generic_patterns, quote=False))
    )
    file = F.regexp_extract(F.regexp_replace(F.replace(url, F.lit("%20"), F.lit("_")), "[?#].*$", ""), "([^/]*)$", 1)
    stem = squeeze(F.regexp_replace(F.regexp_replace(file, "(?<=.)\\.[^.]*$", ""), "[_%\\-]+", " "))
    tail = F.substring(F.regexp_replace(F.regexp_extract(url, "([^/]*)$", 1), "\\?.*$", ""), 1, 80)
    named = F.concat(F.lit(f"{prefix} - " if prefix else ""), F.when(F.length(stem) < 3, tail).otherwise(stem))
    return F.substring(F.when(generic, named).otherwise(squeeze(text)), 1, 200)


def crawlable(url: Column, page: Column, depth: Column, settings: Settings = Settings()) -> Column:
    """Links to follow: not too deep, same site, one of the words, none of the patterns to skip; not PDF files."""
    wanted = F.lower(url).rlike(alternation([w.lower() for w in settings.must_contain]))
    skipped = url.rlike("(?i)" + alternation(settings.skip_patterns, quote=False))
    return url.isNotNull() & ~is_pdf(url) & (depth < settings.max_depth) & same_domain(url, page) & wanted & ~skipped
