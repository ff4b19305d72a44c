"""Row-level checks.

Every check is a pure Column expression: ``fail`` is a boolean that is true
when the row violates the check, ``message`` says why. A predicate that
evaluates to NULL passes (the engine wraps it in ``coalesce(…, false)``),
except where the check's name is about nulls, in which case the null test is
part of ``fail`` itself. Everything stays inside whole-stage codegen: no UDF.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import (any_of, column_label, current_date, current_ts, to_col,
                      to_value)


@dataclass(frozen=True)
class Condition:
    name: str
    fail: Column
    message: Column


def _msg(*parts: Any) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])


def is_not_null(column: Any) -> Condition:
    c = to_col(column)
    label = column_label(column)
    return Condition(f"{label}_is_null", c.isNull(), _msg(f"Column '{label}' value is null"))


def is_not_empty(column: Any) -> Condition:
    c = to_col(column)
    label = column_label(column)
    return Condition(f"{label}_is_empty", c.cast("string") == F.lit(""),
                     _msg(f"Column '{label}' value is empty"))


def is_not_null_and_not_empty(column: Any, trim_strings: bool = False) -> Condition:
    c = to_col(column).cast("string")
    if trim_strings:
        c = F.trim(c)
    label = column_label(column)
    return Condition(f"{label}_is_null_or_empty", c.isNull() | (c == F.lit("")),
                     _msg(f"Column '{label}' value is null or empty"))


def _list_of_values(allowed: Sequence[Any]) -> Sequence[Any]:
    if isinstance(allowed, (str, bytes)):  # would be taken letter by letter
        raise TypeError(f"allowed is a list of values, not a text: {allowed!r}")
    if not allowed:
        raise ValueError("allowed list must not be empty")
    return allowed


def is_in_list(column: Any, allowed: Sequence[Any]) -> Condition:
    allowed = _list_of_values(allowed)
    c = to_col(column)
    label = column_label(column)
    values = [to_value(v) if not isinstance(v, str) else F.lit(v) for v in allowed]
    shown = ",".join(str(v) for v in allowed)
    return Condition(f"{label}_is_not_in_the_list", c.isNotNull() & ~c.isin(*values),
                     _msg(f"Value '", c, f"' in Column '{label}' is not in the allowed list: [{shown}]"))


def is_not_null_and_is_in_list(column: Any, allowed: Sequence[Any]) -> Condition:
    allowed = _list_of_values(allowed)
    c = to_col(column)
    label = column_label(column)
    values = [to_value(v) if not isinstance(v, str) else F.lit(v) for v in allowed]
    shown = ",".join(str(v) for v in allowed)
    return Condition(f"{label}_is_null_or_is_not_in_the_list", c.isNull() | ~c.isin(*values),
                     _msg(f"Value '", c, f"' in Column '{label}' is null or not in the allowed list: [{shown}]"))


def is_not_null_and_not_empty_array(column: Any) -> Condition:
    c = to_col(column)
    label = column_label(column)
    return Condition(f"{label}_is_null_or_empty_array", c.isNull() | (F.size(c) == 0),
                     _msg(f"Column '{label}' is null or empty array"))


def is_in_range(column: Any, min_limit: Any, max_limit: Any) -> Condition:
    c, lo, hi = to_col(column), to_value(min_limit), to_value(max_limit)
    label = column_label(column)
    return Condition(f"{label}_not_in_range", (c < lo) | (c > hi),
                     _msg("Value ", c, f" in Column '{label}' not in range: [", lo, ", ", hi, "]"))


def is_not_in_range(column: Any, min_limit: Any, max_limit: Any) -> Condition:
    c, lo, hi = to_col(column), to_value(min_limit), to_value(max_limit)
    label = column_label(column)
    return Condition(f"{label}_in_range", (c >= lo) & (c <= hi),
                     _msg("Value ", c, f" in Column '{label}' in range: [", lo, ", ", hi, "]"))


def is_not_less_than(column: Any, limit: Any) -> Condition:
    c, lim = to_col(column), to_value(limit)
    label = column_label(column)
    return Condition(f"{label}_less_than_limit", c < lim,
                     _msg("Value ", c, f" in Column '{label}' is less than limit: ", lim))


def is_not_greater_than(column: Any, limit: Any) -> Condition:
    c, lim = to_col(column), to_value(limit)
    label = column_label(column)
    return Condition(f"{label}_greater_than_limit", c > lim,
                     _msg("Value ", c, f" in Column '{label}' is greater than limit: ", lim))


def is_valid_date(column: Any, date_format: str | None = None) -> Condition:
    c = to_col(column)
    label = column_label(column)
    text = c.cast("string")
    parsed = F.try_to_date(text, date_format) if date_format else text.try_cast("date")
    return Condition(f"{label}_is_not_valid_date", c.isNotNull() & parsed.isNull(),
                     _msg("Value '", c, f"' in Column '{label}' is not a valid date"
                          + (f" with format '{date_format}'" if date_format else "")))


def is_valid_timestamp(column: Any, timestamp_format: str | None = None) -> Condition:
    c = to_col(column)
    label = column_label(column)
    text = c.cast("string")
    if timestamp_format:
        parsed = F.try_to_timestamp(text, F.lit(timestamp_format))
    else:
        parsed = text.try_cast("timestamp")
    return Condition(f"{label}_is_not_valid_timestamp", c.isNotNull() & parsed.isNull(),
                     _msg("Value '", c, f"' in Column '{label}' is not a valid timestamp"
                          + (f" with format '{timestamp_format}'" if timestamp_format else "")))


def _plus_seconds(ts: Column, seconds: Any) -> Column:
    return ts + F.make_dt_interval(secs=to_value(seconds).cast("decimal(18,6)"))


def is_not_in_future(column: Any, offset: Any = 0, curr_timestamp: Any = None) -> Condition:
    c = to_col(column)
    label = column_label(column)
    bound = _plus_seconds(current_ts(curr_timestamp), offset)
    return Condition(f"{label}_in_future", c > bound,
                     _msg("Value '", c, f"' in Column '{label}' is greater than time '", bound, "'"))


def is_not_in_near_future(column: Any, offset: Any = 0, curr_timestamp: Any = None) -> Condition:
    c = to_col(column)
    label = column_label(column)
    now = current_ts(curr_timestamp)
    bound = _plus_seconds(now, offset)
    return Condition(f"{label}_in_near_future", (c > now) & (c < bound),
                     _msg("Value '", c, f"' in Column '{label}' is greater than '", now,
                          "' and smaller than '", bound, "'"))


def is_older_than_n_days(column: Any, days: int, curr_date: Any = None, negate: bool = False) -> Condition:
    """Fails when the value is not at least ``days`` days before the current date.

    Exactly ``days`` days passes. With ``negate`` the check fails when it *is*
    at least that old.
    """
    c = to_col(column)
    label = column_label(column)
    age = F.datediff(current_date(curr_date), c.cast("date"))
    older = age >= F.lit(int(days))
    fail = older if negate else ~older
    word = "is" if negate else "is not"
    return Condition(f"{label}_{'' if negate else 'not_'}older_than_{int(days)}_days", fail,
                     _msg("Value '", c, f"' in Column '{label}' {word} at least {int(days)} days old"))


def is_older_than_col2_for_n_days(column1: Any, column2: Any, days: int, negate: bool = False) -> Condition:
    c1, c2 = to_col(column1), to_col(column2)
    l1, l2 = column_label(column1), column_label(column2)
    gap = F.datediff(c2.cast("date"), c1.cast("date"))
    older = gap >= F.lit(int(days))
    fail = older if negate else ~older
    word = "is" if negate else "is not"
    return Condition(f"{l1}_{'' if negate else 'not_'}older_than_{l2}_for_{int(days)}_days", fail,
                     _msg("Value '", c1, f"' in Column '{l1}' {word} at least {int(days)} days older than '",
                          c2, f"' in Column '{l2}'"))


def regex_match(column: Any, regex: str, negate: bool = False) -> Condition:
    c = to_col(column)
    label = column_label(column)
    hit = c.cast("string").rlike(regex)
    fail = hit if negate else ~hit
    return Condition(f"{label}_{'matching' if negate else 'not_matching'}_regex", fail,
                     _msg(f"Column '{label}' value ", "matches" if negate else "does not match",
                          f" regex '{regex}'"))


# Fixed value: one octet 0-255 without leading zeros, and the dotted quad.
IPV4_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{IPV4_OCTET}\.{IPV4_OCTET}\.{IPV4_OCTET}\.{IPV4_OCTET}$"


def ipv4_to_long(text: Column) -> Column:
    """Dotted quad → bigint (caller checks validity first)."""
    parts = F.split(text, r"\.")
    return F.aggregate(F.transform(parts, lambda p: p.cast("bigint")), F.lit(0).cast("bigint"),
                       lambda acc, p: acc * 256 + p)


def is_valid_ipv4_address(column: Any) -> Condition:
    c = to_col(column)
    label = column_label(column)
    return Condition(f"{label}_does_not_match_pattern_ipv4_address",
                     c.isNotNull() & ~c.cast("string").rlike(IPV4_PATTERN),
                     _msg(f"Value '", c, f"' in Column '{label}' is not a valid IPv4 address"))


def _parse_cidr(cidr_block: str) -> tuple[int, int]:
    addr, _, prefix = cidr_block.strip().partition("/")
    octets = [int(x) for x in addr.split(".")]
    if len(octets) != 4 or any(o < 0 or o > 255 for o in octets):
        raise ValueError(f"invalid CIDR block {cidr_block!r}")
    bits = int(prefix) if prefix else 32
    if not 0 <= bits <= 32:
        raise ValueError(f"invalid CIDR prefix in {cidr_block!r}")
    value = (octets[0] << 24) | (octets[1] << 16) | (octets[2] << 8) | octets[3]
    return value, bits


def is_ipv4_address_in_cidr(column: Any, cidr_block: str) -> Condition:
    """Fails for invalid addresses and for valid ones outside the block."""
    c = to_col(column)
    label = column_label(column)
    net, bits = _parse_cidr(cidr_block)
    shift = 32 - bits
    text = c.cast("string")
    valid = text.rlike(IPV4_PATTERN)
    inside = F.shiftright(ipv4_to_long(text), shift) == F.lit(net >> shift)
    fail = c.isNotNull() & (~valid | ~F.when(valid, inside).otherwise(F.lit(False)))
    return Condition(f"{label}_is_not_ipv4_in_cidr", fail,
                     _msg("Value '", c, f"' in Column '{label}' is not a valid IPv4 address in block {cidr_block}"))


def sql_expression(expression: str, msg: str | None = None, name: str | None = None,
                   negate: bool = False, columns: Sequence[Any] | None = None) -> Condition:
    """Passes when the expression is true (fails when false); ``negate`` flips."""
    cond = F.expr(expression)
    fail = cond if negate else ~cond
    prefix = column_label(list(columns)) + "_" if columns else ""
    default_name = prefix + column_label(expression)
    text = msg or f"Value is {'' if negate else 'not '}matching expression: {expression}"
    return Condition(name or default_name, fail, F.lit(text))


# The personal-data patterns C21 looks for, by kind.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "phone": r"(?:\+|\b)\d[\d ().-]{7,}\d\b",
    "card": r"\b\d(?:[ -]?\d){12,18}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
}
# How many digits an international phone number has at least and at most.
PHONE_DIGITS = (9, 15)


# A literal every match must contain: checked first (cheap), so the regex runs only where it can match.
_PII_REQUIRED = {"email": "@", "ipv4": "."}


def _iban_remainder(iban: Column) -> Column:
    """The first four characters go to the end, letters count from 10, and the number's remainder by 97 is taken digit by digit."""
    moved = F.split(F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4)), "")
    values = F.transform(F.filter(moved, lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _is_phone(match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    # not a bare number, nor four dotted ones, which are an address, right or wrong
    return digits.between(*PHONE_DIGITS) & match.rlike(r"[^0-9]") & ~match.rlike(r"^\d+(\.\d+){3}$")


# What a match must fulfil beyond its pattern; a match that doesn't is dropped.
_PII_VERIFIED = {
    "ipv4": lambda m: F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255),
    "phone": _is_phone,
    "card": lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", "")),
    "iban": lambda m: _iban_remainder(m) == 1,
}


def _pii_hit(text: Column, kind: str) -> Column:
    hit = text.rlike(PII_PATTERNS[kind])
    if kind in _PII_VERIFIED:  # the matches are taken out only of texts that have one
        matches = F.regexp_extract_all(text, F.lit(PII_PATTERNS[kind]), F.lit(0))
        hit = F.when(hit, F.exists(matches, _PII_VERIFIED[kind])).when(text.isNotNull(), F.lit(False))
    need = _PII_REQUIRED.get(kind)
    return (F.instr(text, need) > 0) & hit if need else hit


def contains_pii(column: Any, kinds: Sequence[str] | None = None) -> Condition:
    """Fails when the text holds personal data of the given kinds.

    A match of a kind's pattern counts when it verifies: card numbers by their
    check digit (Luhn), account numbers (IBAN) by their remainder by 97,
    addresses by the range of their parts, phone numbers by their number of
    digits. So a number with one wrong digit passes.
    """
    c = to_col(column).cast("string")
    label = column_label(column)
    kinds = list(kinds or PII_PATTERNS)
    # built apart for verdict and message: Spark may evaluate a second copy of an expression with a lambda wrongly
    found = F.concat_ws(",", *[F.when(_pii_hit(c, k), F.lit(k)) for k in kinds])
    fail = any_of(_pii_hit(c, k) for k in kinds)
    return Condition(f"{label}_contains_pii", fail,
                     _msg(f"Column '{label}' contains personal data: ", found))


def is_data_fresh(column: Any, max_age_minutes: int, base_timestamp: Any = None) -> Condition:
    """Fails when the value is older than ``base - max_age_minutes`` (exactly N minutes passes)."""
    c = to_col(column)
    label = column_label(column)
    bound = current_ts(base_timestamp) - F.make_dt_interval(mins=F.lit(int(max_age_minutes)))
    return Condition(f"{label}_is_data_fresh", c < bound,
                     _msg("Value '", c, f"' in Column '{label}' is older than {int(max_age_minutes)} minutes from '",
                          bound, "'"))


# name → builder for the rule engine
ROW_CHECKS = {
    "is_not_null": is_not_null,
    "is_not_empty": is_not_empty,
    "is_not_null_and_not_empty": is_not_null_and_not_empty,
    "is_in_list": is_in_list,
    "is_not_null_and_is_in_list": is_not_null_and_is_in_list,
    "is_not_null_and_not_empty_array": is_not_null_and_not_empty_array,
    "is_in_range": is_in_range,
    "is_not_in_range": is_not_in_range,
    "is_not_less_than": is_not_less_than,
    "is_not_greater_than": is_not_greater_than,
    "is_valid_date": is_valid_date,
    "is_valid_timestamp": is_valid_timestamp,
    "is_not_in_future": is_not_in_future,
    "is_not_in_near_future": is_not_in_near_future,
    "is_older_than_n_days": is_older_than_n_days,
    "is_older_than_col2_for_n_days": is_older_than_col2_for_n_days,
    "regex_match": regex_match,
    "is_valid_ipv4_address": is_valid_ipv4_address,
    "is_ipv4_address_in_cidr": is_ipv4_address_in_cidr,
    "sql_expression": sql_expression,
    "contains_pii": contains_pii,
    "is_data_fresh": is_data_fresh,
}

__all__ = ["Condition", "ROW_CHECKS"] + list(ROW_CHECKS)
