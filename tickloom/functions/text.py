"""News text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headline words that keep a market-wide item.
MACRO_WORDS = (
    "NIFTY", "SENSEX", "RBI", "SEBI", "FII", "FPI", "INFLATION", "GDP", "REPO RATE", "MONETARY POLICY",
    "BUDGET", "F&O", "DERIVATIVES",
)
# Event words in the order in which they decide.
EVENT_WORDS = (
    ("EARNINGS", ("RESULT", "EARNING", "FINANCIAL", "QUARTERLY", "Q1", "Q2", "Q3", "Q4")),
    ("DIVIDEND", ("DIVIDEND", "INTERIM DIV", "FINAL DIV")),
    ("BOARD_MEETING", ("BOARD MEETING", "BOARD MTG")),
    ("AGM", ("AGM", "EGM", "ANNUAL GENERAL")),
    ("BONUS_SPLIT", ("BONUS", "SPLIT", "SUBDIVISION")),
    ("RIGHTS_ISSUE", ("RIGHTS", "RIGHT ISSUE")),
    ("MERGER", ("MERGER", "AMALGAMATION", "ACQUISITION", "TAKEOVER")),
)
# Fixed values: (type, last day, action, factor, pause minutes), first match wins.
EVENT_IMPACT = (
    ("EARNINGS", 0, "PAUSE", 3.0, 120), ("EARNINGS", 1, "WIDEN", 2.0, 0), ("EARNINGS", 3, "WIDEN", 1.5, 0),
    ("EARNINGS", 7, "WIDEN", 1.2, 0), ("MERGER", 1, "AVOID", 5.0, 0), ("MERGER", 7, "WIDEN", 2.5, 0),
    ("BOARD_MEETING", 0, "WIDEN", 1.5, 0), ("BOARD_MEETING", 2, "WIDEN", 1.2, 0),
    ("BONUS_SPLIT", 1, "WIDEN", 1.3, 0), ("DIVIDEND", 0, "WIDEN", 1.2, 0),
)
# Precedence of event types when one must represent a symbol.
EVENT_RANK = ("MERGER", "EARNINGS", "BOARD_MEETING", "AGM", "BONUS_SPLIT", "DIVIDEND", "RIGHTS_ISSUE", "OTHER")
ACTIONS = ("NORMAL", "WIDEN", "PAUSE", "AVOID")


def news_id(source: Column, headline: Column) -> Column:
    """First twelve hex digits of md5("source:headline")."""
    return F.substring(F.md5(F.concat_ws(":", source, headline)), 1, 12)


def strip_html(html: Column, max_chars: int | None = None) -> Column:
    """Tags out, whitespace collapsed. The whole text unless a display length is asked for."""
    t = F.regexp_replace(html, "<[^>]+>", " ")
    t = F.trim(F.regexp_replace(t, "[ \\t\\n\\r\\f]+", " "))
    return t if max_chars is None else F.substring(t, 1, max_chars)


def exchange_tags(text: Column) -> Column:
    """Symbols written as NSE: ABC or BSE: ABC."""
    one = [F.regexp_extract_all(F.upper(text), F.lit(x + "[: \\t\\n\\r\\f]+([A-Z]{2,10})"), F.lit(1)) for x in ("NSE", "BSE")]
    return F.array_union(*one)


def parse_date(text: Column) -> Column:
    """Timestamp of 05-Jan-2024, ISO dates and times, and mail-style dates; else NULL."""
    t = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")
    formats = ("dd-MMM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def event_class(description: Column) -> Column:
    d = F.upper(description)
    out = F.lit("OTHER")
    for name, words in reversed(EVENT_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | d.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def event_impact(event_type: Column, days: Column) -> Column:
    """Struct (action, factor, pause_minutes) for an event ``days`` ahead."""
    def made(a, f, p):
        return F.struct(F.lit(a).alias("action"), F.lit(f).alias("factor"), F.lit(p).alias("pause_minutes"))

    out = made("NORMAL", 1.0, 0)
    for kind, last, a, f, p in reversed(EVENT_IMPACT):
        out = F.when((event_type == kind) & (days <= last), made(a, f, p)).otherwise(out)
    return out


def rank_in(value: Column, names) -> Column:
    out = F.lit(len(names))
    for i, n in enumerate(names):
        out = F.when(value == n, i).otherwise(out)
    return out
