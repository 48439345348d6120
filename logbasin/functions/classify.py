"""Classification of a request. Thresholds and labels are data (profiles)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the alert filter.
SLOW_MS = 5000
LARGE_BYTES = 10 * 1024 * 1024
ERROR_KEYWORDS = ["ERROR", "CRITICAL", "FATAL", "EXCEPTION", "FAILED"]


@dataclass(frozen=True)
class Profile:
    """One set of classification rules.

    ``status`` and ``response_time`` are (upper bound, label) steps; a value at
    or above the last bound gets the ``*_above`` label. With ``zero_unknown`` a
    null or zero value gets ``unknown``; otherwise null also gets ``*_above``.
    """

    status: tuple[tuple[int, str], ...]
    status_above: str
    response_time: tuple[tuple[int, str], ...]
    response_time_above: str
    slow_ms: int = 5000
    zero_unknown: bool = True
    mobile_tokens: tuple[str, ...] = ()
    mobile_ignore_case: bool = False
    content: tuple[tuple[tuple[str, ...], str], ...] = ()
    content_ignore_case: bool = False
    cache_misses: tuple[str, ...] = ("", "-")
    cache_age_positive: bool = False
    version: str | None = None


# Labels, thresholds and word lists of the profiles in use.
_LABELS = ((200, "unknown"), (300, "success"), (400, "redirect"), (500, "client_error"))

_MAIN_CONTENT = (
    (("javascript",), "js"),
    (("css",), "css"),
    (("image",), "image"),
    (("html",), "html"),
    (("json", "api"), "api"),
)

_LEGACY_CONTENT = (
    (("text/html",), "html"),
    (("application/javascript", "text/javascript"), "javascript"),
    (("text/css",), "css"),
    (("image/",), "image"),
    (("font/", "woff"), "font"),
    (("application/json", "application/xml"), "api"),
    (("video/",), "video"),
    (("audio/",), "audio"),
    (("application/pdf",), "document"),
)

PROFILES = {
    "main": Profile(
        status=_LABELS,
        status_above="server_error",
        response_time=((100, "fast"), (1000, "normal"), (5000, "slow")),
        response_time_above="very_slow",
        mobile_tokens=("Mobile", "iPhone", "Android", "iPad", "Windows Phone"),
        content=_MAIN_CONTENT,
        version="3.0-multiformato",
    ),
    "legacy_udf": Profile(
        status=_LABELS,
        status_above="server_error",
        response_time=((100, "fast"), (500, "normal"), (2000, "slow")),
        response_time_above="critical",
        mobile_tokens=(
            "mobile", "android", "iphone", "ipad", "ipod",
            "blackberry", "windows phone", "opera mini",
        ),
        mobile_ignore_case=True,
        content=_LEGACY_CONTENT,
        content_ignore_case=True,
        cache_misses=("", '""', '"'),
        version="2.1.0",
    ),
    "legacy_native": Profile(
        status=((300, "Success"), (400, "Redirect"), (500, "Client Error")),
        status_above="Server Error",
        response_time=((1000, "Fast"), (5000, "Normal")),
        response_time_above="Slow",
        zero_unknown=False,
        version="2.1.0",
    ),
    "bridge": Profile(
        status=((300, "success"), (400, "redirect"), (500, "client_error")),
        status_above="server_error",
        response_time=((100, "fast"), (500, "normal"), (1000, "slow")),
        response_time_above="very_slow",
        slow_ms=1000,
        zero_unknown=False,
        version="2.0",
    ),
    "unquoted": Profile(
        status=_LABELS,
        status_above="server_error",
        response_time=((100, "fast"), (1000, "normal"), (5000, "slow")),
        response_time_above="very_slow",
        slow_ms=1000,
        mobile_tokens=("Mobile",),
        content=_MAIN_CONTENT,
        cache_age_positive=True,
        version="2.0",
    ),
}


def _steps(value: Column, steps: tuple[tuple[int, str], ...], above: str, zero_unknown: bool) -> Column:
    chain = F.when(value.isNull() | (value == 0), "unknown") if zero_unknown else F
    for bound, label in steps:
        chain = chain.when(value < bound, label)
    return chain.otherwise(above)


def is_error(code: Column, profile: Profile) -> Column:
    flag = code >= 400
    return F.coalesce(flag, F.lit(False)) if profile.zero_unknown else flag


def status_category(code: Column, profile: Profile) -> Column:
    return _steps(code, profile.status, profile.status_above, profile.zero_unknown)


def is_slow(time_ms: Column, profile: Profile) -> Column:
    flag = time_ms > profile.slow_ms
    return F.coalesce(flag, F.lit(False)) if profile.zero_unknown else flag


def response_time_category(time_ms: Column, profile: Profile) -> Column:
    return _steps(time_ms, profile.response_time, profile.response_time_above, profile.zero_unknown)


def is_large(size: Column) -> Column:
    return F.coalesce(size > LARGE_BYTES, F.lit(False))


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def is_mobile(user_agent: Column, profile: Profile) -> Column:
    text = F.lower(user_agent) if profile.mobile_ignore_case else user_agent
    return F.coalesce(_contains_any(text, profile.mobile_tokens), F.lit(False))


def content_category(content_type: Column, profile: Profile) -> Column:
    text = F.lower(content_type) if profile.content_ignore_case else content_type
    chain = F.when(content_type.isNull() | (content_type == ""), "unknown")
    for words, label in profile.content:
        chain = chain.when(_contains_any(text, words), label)
    return chain.otherwise("other")


def cache_hit(age: Column, profile: Profile) -> Column:
    if profile.cache_age_positive:
        return F.coalesce(age.try_cast("bigint") > 0, F.lit(False))
    return F.coalesce(~age.isin(*profile.cache_misses), F.lit(False))


def request_domain(resource: Column) -> Column:
    """First piece of the path; empty for absolute paths."""
    return F.when(~resource.isin("", "-"), F.substring_index(resource, "/", 1))


def request_path_depth(resource: Column) -> Column:
    pieces = F.size(F.filter(F.split(resource, "/"), lambda piece: piece != ""))
    return F.when(~resource.isin("", "-"), pieces).otherwise(0)


def file_extension(resource: Column) -> Column:
    """Text after the last dot, cut at a question mark."""
    tail = F.substring_index(F.substring_index(resource, ".", -1), "?", 1)
    return F.when(F.contains(resource, F.lit(".")), F.lower(tail))


def environment(node: Column) -> Column:
    return F.coalesce(node, F.lit("UNKNOWN"))


def device_type(mobile: Column) -> Column:
    return F.when(mobile, "Mobile").otherwise("Desktop")


def has_error_digit(code: Column) -> Column:
    """True if the code, as text, starts with 4 or 5 (so 45 counts too)."""
    return F.substring(code.cast("string"), 1, 1).isin("4", "5")


def error_category(code: Column, time_ms: Column, size: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when((code >= 400) & (code < 500), "client_error").when(code >= 500, "server_error"),
            F.when(time_ms > SLOW_MS, "performance_slow"),
            F.when(size > LARGE_BYTES, "performance_large"),
        )
    )
    return F.when(F.size(parts) > 0, F.concat_ws(",", parts)).otherwise("unknown")


def error_reasons(code: Column, time_ms: Column, size: Column) -> Column:
    """Messages for everything that makes a request worth an alert; empty if nothing does."""
    kind = F.when(F.startswith(code.cast("string"), F.lit("4")), "client_error").otherwise("server_error")
    return F.array_compact(
        F.array(
            F.when(has_error_digit(code), F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" ("), kind, F.lit(")"))),
            F.when(
                time_ms > SLOW_MS,
                F.concat(F.lit("Slow response: "), time_ms.cast("string"), F.lit(f"ms (threshold: {SLOW_MS}ms)")),
            ),
            F.when(
                size > LARGE_BYTES,
                F.concat(
                    F.lit("Large response: "), size.cast("string"), F.lit(f" bytes (threshold: {LARGE_BYTES} bytes)")
                ),
            ),
        )
    )


def needs_alert(code: Column, time_ms: Column, size: Column) -> Column:
    return F.coalesce(has_error_digit(code) | (time_ms > SLOW_MS) | (size > LARGE_BYTES), F.lit(False))


def detected_keywords(text: Column) -> Column:
    upper = F.upper(text)
    return F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(k)), k) for k in ERROR_KEYWORDS]))
