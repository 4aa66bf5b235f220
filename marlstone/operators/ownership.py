"""Ownership documents (XML) as Markdown reports, by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles, and the columns of the tables, with their elements.
_ROLES = (("isDirector", "Director", None), ("isOfficer", "Officer", "officerTitle"), ("isTenPercentOwner", "10% owner", None), ("isOther", "Other", "otherText"))
_TABLES = (
    ("Non-derivative transactions", "nonDerivativeTransaction", (("Date", "transactionDate"), ("Code", "transactionCode"), ("Shares", "transactionShares"), ("Acquired/Disposed", "transactionAcquiredDisposedCode"), ("Price", "transactionPricePerShare"), ("Post-tx holdings", "sharesOwnedFollowingTransaction"), ("Security", "securityTitle"))),
    ("Derivative transactions", "derivativeTransaction", (("Date", "transactionDate"), ("Code", "transactionCode"), ("Shares", "transactionShares"), ("Acquired/Disposed", "transactionAcquiredDisposedCode"), ("Strike", "conversionOrExercisePrice"), ("Underlying", "underlyingSecurityTitle"), ("Security", "securityTitle"))),
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _plain(xml: Column) -> Column:
    """Without prolog, comments and name spaces, CDATA as text, in an element w, so that any XML parser goes through all of it."""
    cdata = F.transform(F.split(xml, r"<!\[CDATA\[|\]\]>"), lambda s, i: F.when(i % 2 == 1, F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))).otherwise(s))
    x = F.array_join(cdata, "")
    for dropped in (r"(?s)<!--.*?-->", r"^\s*<\?xml[^>]*\?>", r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')"):
        x = F.regexp_replace(x, dropped, "")
    return F.concat(F.lit("<w>"), x, F.lit("</w>"))


# Attributes of an element.
_ATTRIBUTES = r"(?:\s+[^\s=<>/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*"


def _unescaped(text: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def _walked(xml: Column, path: str) -> Column:
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"({path})[1]/value/text() | ({path})[1][not(value)]/text()"))), F.lit(""))


def _value(xml: Column, path: str) -> Column:
    """Text of the first element of the path's name, or of its value element; NULL if there is none or it is empty.

    A plain element is cut out by pattern: one that is empty, holds text alone, or begins with a value element that does. For any other the path is walked, which parses the document.
    """
    tag = path.rsplit("/", 1)[1]
    # Up to the end of the text. The empty branch takes the first element of the name whatever it holds, so that no later one is found instead.
    first = F.regexp_extract(xml, rf"<{tag}(?=[\s/>])(?:{_ATTRIBUTES}(?:/>|>\s*<value{_ATTRIBUTES}>[^<>\r]+(?=<)|>[^<>\r]*(?=</{tag}\s*>))|)", 0)
    text = lambda e: let(F.trim(F.substring_index(e, ">", -1)), lambda t: F.when(t != "", F.when(F.contains(t, F.lit("&")), F.trim(_unescaped(t))).otherwise(t)))
    odd = lambda e: (e == f"<{tag}") | F.contains(xml, F.lit("<?")) | (F.contains(e, F.lit("&")) & F.rlike(e, F.lit("&(?!(?:lt|gt|quot|apos|amp);)")))
    cut = let(first, lambda e: F.when((e != "") & ~e.endswith("/>"), F.when(odd(e), _walked(xml, path)).otherwise(text(e))))
    return F.when(F.contains(xml, F.lit("<" + tag)), cut)  # most elements are absent: nothing is looked for there


def _of_issuer(issuer: Column, xml: Column, name: str) -> Column:
    """Text of the first element of a name in the first issuer, an element of xml."""
    again = F.rlike(F.substring(issuer, 2, 2**31 - 1), F.lit(r"<issuer[\s/>]"))
    return F.when(again, _walked(xml, f"(//issuer)[1]//{name}")).otherwise(_value(issuer, f"//{name}"))


def _elements(xml: Column, name: str) -> Column:
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}{_ATTRIBUTES}(?:/>|>.*?</{name}\s*>)"), F.lit(0))
    return F.when(F.contains(xml, F.lit("<" + name)), found).otherwise(F.array().cast("array<string>"))


def _lines(*lines: Column) -> Column:
    """Those that aren't NULL or empty."""
    return F.array_join(F.filter(F.array(*lines), lambda x: x != ""), "\n")


def _owner(owner: Column) -> Column:
    roles = []
    for flag, role, detail in _ROLES:
        named = F.coalesce(F.concat(F.lit(f"{role} ("), _value(owner, f"//{detail}"), F.lit(")")), F.lit(role)) if detail else F.lit(role)
        roles.append(F.when(F.lower(_value(owner, f"//{flag}")).isin("1", "true", "yes"), named))
    listed = F.array_join(F.array_compact(F.array(*roles)), ", ")
    name = F.coalesce(_value(owner, "//rptOwnerName"), F.lit("(unnamed)"))
    return F.concat(F.lit("- "), name, let(listed, lambda text: F.when(text != "", F.concat(F.lit(" — "), text)).otherwise("")))


def _section(title: str, rows: Column) -> Column:
    return let(rows, lambda r: F.when(F.size(r) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(r, "\n"))))


def _table(w: Column, title: str, tag: str, columns: tuple[tuple[str, str], ...]) -> Column:
    cells = lambda t: F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(_value(t, f"//{name}"), F.lit("—")) for _, name in columns)), " | "), F.lit(" |"))
    head = f"\n| {' | '.join(c for c, _ in columns)} |\n| {' | '.join('---' for _ in columns)} |"
    return _section(title + "\n" + head, F.transform(_elements(w, tag), cells))


def _report(w: Column) -> Column:
    filled = lambda value, prefix: F.concat(F.lit(prefix), value)
    kind = F.coalesce(_value(w, "//documentType"), F.lit("Ownership"))
    named = lambda e, name: _lines(F.lit("## Issuer"), name, *(filled(_of_issuer(e, w, tag), f"- {label}: ") for label, tag in (("Symbol", "issuerTradingSymbol"), ("CIK", "issuerCik"))))
    issuer = let(F.get(_elements(w, "issuer"), F.lit(0)), lambda e: let(filled(_of_issuer(e, w, "issuerName"), "- Name: "), lambda name: F.when(name.isNotNull(), named(e, name))))
    tables = [_table(w, *table) for table in _TABLES]
    note = lambda f: let(_value(f, "/footnote"), lambda text: F.when(text.isNotNull(), F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("("), F.nullif(F.xpath_string(f, F.lit("/footnote/@id")), F.lit("")), F.lit(") ")), F.lit("")), text)))
    notes = F.array_compact(F.transform(_elements(w, "footnote"), note))
    blocks = F.array(F.concat(F.lit("# Form "), kind, F.lit(" — Insider Transaction Report")), filled(_value(w, "//periodOfReport"), "**Period of report:** "), issuer, _section("Reporting owner(s)", F.transform(_elements(w, "reportingOwner"), _owner)), *tables, _section("Footnotes", notes))
    return F.concat(F.array_join(F.array_compact(blocks), "\n\n"), F.lit("\n"))


def xml_report(xml: Column | str) -> Column:
    """An ownership document as a Markdown report; other XML as its text under its name; '' if it can't be read."""
    xml = F.col(xml) if isinstance(xml, str) else xml
    readable = lambda w: F.from_xml(w, "_bad string, _any string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNull()
    safe = let(_plain(F.coalesce(xml, F.lit(""))), lambda w: F.when(readable(w), w).otherwise("<w/>"))
    alone = lambda w: F.xpath_boolean(w, F.lit("count(/w/*) = 1 and not(/w/text()[normalize-space()])"))
    texts = lambda w: F.array_join(F.filter(F.transform(F.xpath(w, F.lit("//text()")), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != ""), "\n")
    name = lambda w: F.xpath_string(w, F.lit("name(/w/*)"))
    other = lambda w: F.concat(F.lit("# "), name(w), F.lit("\n\n"), texts(w), F.lit("\n"))
    root = r"ownershipDocument"
    # One root of that name, told without a walk; all else is walked.
    owned = lambda w: F.rlike(w, F.lit(rf"^<w>\s*<{root}{_ATTRIBUTES}>")) & F.rlike(w, F.lit(rf"</{root}\s*>\s*</w>$")) & (F.regexp_count(w, F.lit(rf"<{root}[\s/>]")) == 1) & ~F.contains(w, F.lit("<?"))
    return let(safe, lambda w: F.when(owned(w), _report(w)).when(~alone(w), "").when(name(w) == "ownershipDocument", _report(w)).otherwise(other(w)))
