"""Error classification: cascades of predicates over (error_type, error_mro, error_message), first match wins.

``default_error`` and ``provider_error`` are Column expressions; ``classify`` is the same rule on a
Python exception, for use inside workers. Types are told by name, so no provider's library is needed.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the classification rules.
RATE_LIMIT_TEXTS = ("429", "resource_exhausted", "quota", "rate limit")
TIMEOUT_TEXTS = ("timeout", "504", "deadline")
LOGIC_TYPES = ("ValueError", "TypeError", "AttributeError", "KeyError", "IndexError", "NameError", "ZeroDivisionError", "AssertionError")
RATE_LIMIT_WAIT = 300.0

#: category -> (is_retryable, is_rate_limit, is_timeout)
CATEGORIES = {
    "rate_limit": (False, True, False),
    "framework_timeout": (True, False, True),
    "api_timeout": (True, False, True),
    "timeout": (True, False, True),
    "connection_error": (True, False, False),
    "validation_error": (True, False, False),
    "logic_error": (False, False, False),
    "client_error": (True, False, False),
    "server_timeout": (True, False, True),
    "server_error": (False, False, False),
    "unknown": (True, False, False),
}


class FrameworkTimeoutError(TimeoutError):
    """The engine's own limit on an attempt ran out."""


def error_struct(category: Column) -> Column:
    """The error columns that a category stands for."""
    flag = [functools.reduce(lambda e, c, k=k: e.when(category == c[0], F.lit(c[1][k])), CATEGORIES.items(), F.when(F.lit(False), F.lit(None))) for k in range(3)]
    return F.when(category.isNotNull(), F.struct(flag[0].alias("is_retryable"), flag[1].alias("is_rate_limit"), flag[2].alias("is_timeout"), category.alias("error_category"), F.when(category == "rate_limit", F.lit(RATE_LIMIT_WAIT)).alias("suggested_wait")))


def _any_text(message: Column, texts: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return functools.reduce(operator.or_, [low.contains(t) for t in texts])


def _is(mro: Column, *names: str) -> Column:
    """``mro`` is the error's type and the types it derives from, as an array."""
    return F.arrays_overlap(mro, F.array(*[F.lit(n) for n in names]))


def default_category(mro: Column, message: Column) -> Column:
    """The provider-agnostic cascade. Our own timeouts are told by type before any text is looked at."""
    return (
        F.when(_is(mro, "FrameworkTimeoutError"), "framework_timeout")
        .when(_any_text(message, RATE_LIMIT_TEXTS), "rate_limit")
        .when(_is(mro, "TimeoutError") | _any_text(message, ("timeout",)), "api_timeout")
        .when(_is(mro, "ConnectionError") | _any_text(message, ("connection",)), "connection_error")
        .when(_is(mro, "ValidationError"), "validation_error")
        .when(_is(mro, *LOGIC_TYPES), "logic_error")
        .otherwise("unknown")
    )


def provider_category(mro: Column, message: Column) -> Column:
    """The cascade for providers with client and server error types."""
    limited, late = _any_text(message, RATE_LIMIT_TEXTS), _any_text(message, TIMEOUT_TEXTS)
    return (
        F.when(_is(mro, "FrameworkTimeoutError"), "framework_timeout")
        .when(_is(mro, "ClientError"), F.when(limited, "rate_limit").otherwise("client_error"))
        .when(_is(mro, "ServerError"), F.when(late, "server_timeout").otherwise("server_error"))
        .when(_is(mro, "UnexpectedModelBehavior"), "validation_error")
        .when(limited, "rate_limit")
        .when(late, "timeout")
        .when(_is(mro, "ValidationError"), "validation_error")
        .when(_is(mro, *LOGIC_TYPES), "logic_error")
        .otherwise("unknown")
    )


def is_validation(error_type: Column, message: Column, category: Column) -> Column:
    """The second, separate test that only decides that a retry need not wait."""
    low = F.lower(F.coalesce(error_type, F.lit("")))
    return low.contains("validation") | low.contains("parse") | low.contains("unexpectedmodelbehavior") | F.lower(F.coalesce(message, F.lit(""))).contains("result validation") | F.coalesce(category == "validation_error", F.lit(False))


def mro_of(error: BaseException) -> list[str]:
    return [t.__name__ for t in type(error).__mro__]


def classify(error: BaseException) -> str:
    """The default cascade on an exception."""
    names, text = set(mro_of(error)), str(error).lower()
    if "FrameworkTimeoutError" in names:
        return "framework_timeout"
    if any(t in text for t in RATE_LIMIT_TEXTS):
        return "rate_limit"
    if "TimeoutError" in names or "timeout" in text:
        return "api_timeout"
    if "ConnectionError" in names or "connection" in text:
        return "connection_error"
    if "ValidationError" in names:
        return "validation_error"
    return "logic_error" if names & set(LOGIC_TYPES) else "unknown"


def classify_provider(error: BaseException) -> str:
    """The provider cascade on an exception."""
    names, text = set(mro_of(error)), str(error).lower()
    limited, late = any(t in text for t in RATE_LIMIT_TEXTS), any(t in text for t in TIMEOUT_TEXTS)
    if "FrameworkTimeoutError" in names:
        return "framework_timeout"
    if "ClientError" in names:
        return "rate_limit" if limited else "client_error"
    if "ServerError" in names:
        return "server_timeout" if late else "server_error"
    if "UnexpectedModelBehavior" in names:
        return "validation_error"
    if limited or late:
        return "rate_limit" if limited else "timeout"
    if "ValidationError" in names:
        return "validation_error"
    return "logic_error" if names & set(LOGIC_TYPES) else "unknown"


def safely(classifier, error: BaseException) -> str:
    """The classifier's category; ``unknown`` if it fails or names none of CATEGORIES."""
    try:
        category = classifier(error)
    except Exception:
        return "unknown"
    return category if category in CATEGORIES else "unknown"


def retry_needs_no_wait(error: BaseException, category: str) -> bool:
    name = type(error).__name__.lower()
    return "validation" in name or "parse" in name or "unexpectedmodelbehavior" in name or "result validation" in str(error).lower() or category == "validation_error"


def usage_of(error: BaseException) -> dict[str, int]:
    """Tokens that a failed attempt cost, as far as the exception tells; zeros otherwise."""

    def counts(usage) -> dict[str, int]:
        usage = usage() if callable(usage) else usage
        get = usage.get if isinstance(usage, dict) else lambda k: getattr(usage, k, None)
        given, made = get("input_tokens") or get("request_tokens") or 0, get("output_tokens") or get("response_tokens") or 0
        return {"input_tokens": given, "output_tokens": made, "total_tokens": get("total_tokens") or given + made}

    for holder in (getattr(error.__cause__, "result", None), error):
        if getattr(holder, "usage", None) is not None:
            return counts(holder.usage)
    return counts(error.__dict__.get("_failed_token_usage") or {})
