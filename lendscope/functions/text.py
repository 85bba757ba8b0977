"""Formatting expressions (FN-08 .. FN-15, FN-19 .. FN-21, FN-26 .. FN-28, PRJ-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
INVALID_FILENAME_CHARS = '<>:"/\\|?*'
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def format_currency(x, currency: str = "USD") -> Column:                      # FN-08
    v = F.format_number(_c(x), 2)
    neg = _c(x) < 0
    if currency == "USD":
        return F.when(neg, F.concat(F.lit("$-"), F.format_number(F.abs(_c(x)), 2))).otherwise(F.concat(F.lit("$"), v))
    return F.concat(v, F.lit(f" {currency}"))


def format_percentage(x, decimals: int = 2) -> Column:                       # FN-09
    return F.concat(F.format_string(f"%.{decimals}f", _c(x) * F.lit(100.0)), F.lit("%"))


def format_large_number(x) -> Column:                                       # FN-10
    v = _c(x)
    a = F.abs(v)
    return (F.when(a >= 1e9, F.concat(F.format_string("%.1f", v / 1e9), F.lit("B")))
            .when(a >= 1e6, F.concat(F.format_string("%.1f", v / 1e6), F.lit("M")))
            .when(a >= 1e3, F.concat(F.format_string("%.1f", v / 1e3), F.lit("K")))
            .otherwise(F.format_string("%.1f", v)))


def truncate_string(x, max_length: int = 100, suffix: str = "...") -> Column:  # FN-11
    v = _c(x)
    keep = max(max_length - len(suffix), 0)
    return F.when(F.length(v) <= max_length, v).otherwise(F.concat(F.substring(v, 1, keep), F.lit(suffix)))


def clean_filename(x) -> Column:                                            # FN-12
    v = F.translate(_c(x), INVALID_FILENAME_CHARS, "_" * len(INVALID_FILENAME_CHARS))
    v = F.regexp_replace(v, r"^[ .]+|[ .]+$", "")
    ext = F.regexp_extract(v, r"(\.[^.]*)$", 1)
    name = F.regexp_replace(v, r"\.[^.]*$", "")
    capped = F.concat(name.substr(F.lit(1), F.lit(255) - F.length(ext)), ext)
    return F.when(F.length(v) > 255, capped).otherwise(v)


def file_size_human(x) -> Column:                                           # FN-13
    v = _c(x).cast("double")
    expr = None
    for i, u in enumerate(SIZE_UNITS):
        lo = 1024.0 ** (i + 1)
        piece = F.concat(F.format_string("%.1f", v / F.lit(1024.0 ** i)), F.lit(f" {u}"))
        expr = F.when(v < lo, piece) if expr is None else expr.when(v < lo, piece)
    return expr.otherwise(F.concat(F.format_string("%.1f", v / F.lit(1024.0 ** 5)), F.lit(" PB")))


def parse_duration_seconds(x) -> Column:                                    # FN-14
    s = F.lower(F.trim(_c(x)))
    unit = F.regexp_extract(s, r"([smhd])$", 1)
    num = F.regexp_extract(s, r"^(-?\d+)[smhd]?$", 1)
    mult = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(num != "", num.cast("long") * mult)


def format_duration(seconds) -> Column:                                     # FN-15
    t = _c(seconds).cast("long")
    m, s = F.floor(t / 60), t % 60
    h, hm = F.floor(t / 3600), F.floor((t % 3600) / 60)
    d, dh = F.floor(t / 86400), F.floor((t % 86400) / 3600)

    def two(a, ua, b, ub):
        return F.when(b != 0, F.concat(a.cast("string"), F.lit(ua + " "), b.cast("string"), F.lit(ub))) \
            .otherwise(F.concat(a.cast("string"), F.lit(ua)))

    return (F.when(t < 60, F.concat(t.cast("string"), F.lit("s")))
            .when(t < 3600, two(m, "m", s, "s")).when(t < 86400, two(h, "h", hm, "m"))
            .otherwise(two(d, "d", dh, "h")))


def title_case_metric(x) -> Column:                                         # FN-20
    return F.initcap(F.regexp_replace(_c(x), "_", " "))


# --- fixed values (must equal the reference for equal results) -------------
SCORE_METRICS = ("accuracy", "precision", "recall", "f1_score", "auc_score")
TIME_METRICS = ("response_time", "prediction_time")
RATE_METRICS = ("error_rate", "drift_rate")
USAGE_METRICS = ("cpu_usage", "memory_usage", "disk_usage")
COUNT_METRICS = ("request_count", "prediction_count")


def format_metric(name, value) -> Column:                                    # FN-19
    n, v = _c(name), _c(value).cast("double")
    return (F.when(n.isin(*SCORE_METRICS), F.concat(F.format_string("%.4f", v), F.lit(" ("),
                                                    F.format_string("%.1f", v * 100.0), F.lit("%)")))
            .when(n.isin(*TIME_METRICS) & (v < 1.0), F.concat(F.format_string("%.1f", v * 1000.0), F.lit("ms")))
            .when(n.isin(*TIME_METRICS), F.concat(F.format_string("%.2f", v), F.lit("s")))
            .when(n.isin(*RATE_METRICS), F.concat(F.format_string("%.2f", v * 100.0), F.lit("%")))
            .when(n.isin(*USAGE_METRICS), F.concat(F.format_string("%.1f", v), F.lit("%")))
            .when(n.isin(*COUNT_METRICS), F.format_number(v.cast("long"), 0))
            .otherwise(F.format_string("%.4f", v)))


def format_uptime(seconds) -> Column:                                        # FN-21
    t = _c(seconds).cast("long")
    d, h, m = (F.floor(x).cast("string") for x in (t / 86400, (t % 86400) / 3600, (t % 3600) / 60))
    return (F.when(t >= 86400, F.concat(d, F.lit("d "), h, F.lit("h "), m, F.lit("m")))
            .when(t >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m"))))


def version_stamp(ts) -> Column:                                             # FN-28
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


def score_display(x) -> Column:                                              # PRJ-15
    return F.coalesce(F.format_string("%.4f", _c(x)), F.lit("N/A"))


def ts_display(x, seconds: bool = True) -> Column:                           # PRJ-15
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss" if seconds else "yyyy-MM-dd HH:mm")


# --- fixed values (must equal the reference for equal results) -------------
AUDIENCE_FOCUS = {
    "technical": "Focus on technical details, model mechanics, and statistical concepts.",
    "business": "Emphasize business implications, practical applications, and strategic insights.",
    "regulatory": "Highlight compliance considerations, regulatory requirements, and documentation needs.",
    "executive": "Provide high-level strategic perspective with actionable recommendations.",
}


def _shown(v: Column, kind: str) -> Column:
    """One value of a profile; null is N/A."""
    if kind == "currency":       # thousands separators, decimals as they are (one at least for fractions)
        digits = F.regexp_replace(F.format_number(v.cast("double"), 6), r"(\.\d+?)0+$", "$1")
        text = F.concat(F.lit("$"), F.when(F.typeof(v).isin("int", "bigint", "smallint", "tinyint"), F.format_number(v.cast("double"), 0)).otherwise(digits))
    elif kind == "percent":
        text = F.concat(F.format_string("%.2f", v.cast("double") * 100), F.lit("%"))
    elif kind == "ratio":
        text = F.format_string("%.2f", v.cast("double"))
    elif kind == "list":
        text = F.array_join(v, ", ")
    else:
        text = v.cast("string")
    return F.when(v.isNull(), F.lit("" if kind == "list" else "N/A")).otherwise(text)


def profile_text(title: str, lines: list[tuple[str, Column, str]]) -> Column:    # FN-26
    """A titled block of "- label: value" lines; kinds: text, currency, percent, ratio, list."""
    shown = [F.concat(F.lit(f"- {label}: "), _shown(v, kind)) for label, v, kind in lines]
    return F.concat_ws("\n", F.lit(f"{title}:"), *shown)


def for_audience(text: Column, audience: Column) -> Column:                    # FN-27
    """The text with the focus of its audience; an unknown audience leaves it unchanged."""
    focus = F.create_map(*[F.lit(x) for kv in AUDIENCE_FOCUS.items() for x in kv])[audience]
    return F.when(focus.isNotNull(), F.concat(text, F.lit("\n\nAUDIENCE FOCUS: "), focus)).otherwise(text)


def with_context(text: Column, context: Column) -> Column:                     # FN-27
    return F.when(context.isNotNull(), F.concat(text, F.lit("\n\nADDITIONAL CONTEXT:\n"), context)).otherwise(text)
