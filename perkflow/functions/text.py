"""Display text built from columns (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkflow import config


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_text(c: Column | str) -> Column:
    """'$1,234.50'; negatives render as '$-1,234.50'."""
    return F.concat(F.lit("$"), F.format_number(_c(c), 2))


def metric_label(prefix: str, c: Column | str) -> Column:
    """prefix || round(decimal, 2) as text, e.g. 'Spend: $5123.50'."""
    return F.concat(F.lit(prefix), F.round(_c(c), 2).cast("string"))


def offer_display(offer_type: Column | str = "offer_type") -> Column:
    """'hotel'/'drink' -> display label; anything else passes through."""
    t = _c(offer_type)
    return (F.when(t == config.HOTEL, F.lit(config.HOTEL_LABEL))
            .when(t == config.DRINK, F.lit(config.DRINK_LABEL))
            .otherwise(t))


def offer_type_of_label(label: str) -> str | None:
    """Display label -> offer type code (None for 'All')."""
    return {config.HOTEL_LABEL: config.HOTEL, config.DRINK_LABEL: config.DRINK}.get(label)


def redeemed_badge(flag: Column | str = "already_redeemed") -> Column:
    return F.when(_c(flag), F.lit(config.REDEEMED_BADGE)).otherwise(F.lit(config.PENDING_BADGE))


def name_matches(c: Column | str, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive regex search (Java regex dialect); NULL -> false.

    ``literal=True`` quotes the pattern so it matches as plain text.
    """
    p = pattern.replace("\\E", "\\E\\\\E\\Q") if literal else pattern
    regex = f"(?i)\\Q{p}\\E" if literal else f"(?i){pattern}"
    return F.coalesce(_c(c).rlike(regex), F.lit(False))


def clock_text(c: Column | str) -> Column:
    return F.date_format(_c(c), "HH:mm:ss")


def datetime_text(c: Column | str) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")
