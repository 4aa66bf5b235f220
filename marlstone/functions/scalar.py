"""Scalar column expressions used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Premium over the risk-free rate by regime colour, in per cent.
HURDLE_PREMIUM = {"green": 4.0, "blue": 4.0, "orange": 6.0, "red": 8.0, "danger": 10.0}


def r6(x: Column) -> Column:
    """Rounded half up to six digits, the same in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def lookup(key: Column, values: dict, default: Column | None = None) -> Column:
    """A small constant mapping as one expression."""
    out = F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
    return F.coalesce(F.when(key.isNotNull(), out), default) if default is not None else F.when(key.isNotNull(), out)


def daily_rate(rate_pct: Column) -> Column:
    return F.pow(1 + rate_pct / 100, 1 / 252) - 1


def hurdle(rate_pct: Column, color: Column) -> Column:
    return F.round(rate_pct + lookup(color, HURDLE_PREMIUM), 2)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """NULL stays NULL: greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def us_or_iso_date(text: Column) -> Column:
    """MM/DD/YYYY, else ISO, else NULL."""
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def quarter_of(date: Column) -> Column:
    return F.quarter(date)


def number(text: Column) -> Column:
    """A finite number or NULL: empty, malformed and NaN give NULL."""
    x = text.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def yield_fraction(x: Column) -> Column:
    """Dividend yields above 1 are given in per cent."""
    return F.when(x > 1, x / 100).otherwise(x)


def money(text: Column) -> Column:
    """'$1.5B' as a number; suffixes T, B and M."""
    clean = F.regexp_replace(F.trim(text), r"[$,]", "")
    scale = lookup(F.upper(F.substring(clean, -1, 1)), {"T": 1e12, "B": 1e9, "M": 1e6})
    return F.when(scale.isNotNull(), F.regexp_replace(clean, r"[A-Za-z]$", "").try_cast("double") * scale).otherwise(clean.try_cast("double"))


def short_money(x: Column) -> Column:
    """A number with suffix T, B or M and one digit, or with thousands marked."""
    a = F.abs(x)
    return F.when(a >= 1e12, F.format_string("$%.1fT", x / 1e12)).when(a >= 1e9, F.format_string("$%.1fB", x / 1e9)).when(a >= 1e6, F.format_string("$%.1fM", x / 1e6)).otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f%%", x)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def citation(ticker: Column, form: Column, filed: Column, path: Column) -> Column:
    return F.format_string("%s %s filed %s → %s", ticker, form, filed.cast("string"), path)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def name_date(path: Column) -> Column:
    """The ISO date in a file name, if there is one."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def stale(date: Column, today: Column, days: int = 14) -> Column:
    return F.datediff(today, date) > days


def without_style_prefix(doc: Column) -> Column:
    return F.regexp_replace(doc, r"^xsl[^/]+/", "")


def content_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".htm") | n.endswith(".html"), "html").when(n.endswith(".xml"), "xml").otherwise("text")


def headed_text(text: Column, title: str = "Document") -> Column:
    """Plain text gets a first-level heading unless it has one."""
    return F.when(F.regexp_like(text, F.lit(r"(?m)^#{1,6}\s")), text).otherwise(F.concat(F.lit(f"# {title}\n\n"), text))


def without_inline_metadata(text: Column) -> Column:
    """Text before the metadata tail, without white space around it."""
    return F.regexp_replace(F.split(text, r"(?m)^X - (?:Definition|References|Details)", 2)[0], r"^\s+|\s+$", "")
