"""Pure column builders: money, days, ratios, intervals, verdicts, texts and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.config import EXPONENTS


def minor(amount: Column) -> Column:
    """A decimal number of currency units as integer hundredths, halves up."""
    return F.floor(amount * 100 + 0.5).cast("long")


def rounded(x: Column, digits: int = 2) -> Column:
    """Half-up toward plus infinity."""
    p = 10.0**digits
    return F.floor(x * p + 0.5) / p


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_change(cur: Column, prev: Column) -> Column:
    return ratio((cur - prev) * 100.0, F.abs(prev))


def trend(change: Column, band: float = 10.0) -> Column:
    return F.when(change > band, "UP").when(change < -band, "DOWN").when(change.isNotNull(), "STABLE")


def volume_trend(cur: Column, prev: Column) -> Column:
    return F.when(prev == 0, F.when(cur > 0, "UP")).otherwise(trend(percent_change(cur, prev)))


def exponent(currency: Column) -> Column:
    out = F.lit(2)
    for code, e in EXPONENTS.items():
        out = F.when(currency == code, e).otherwise(out)
    return out


def parse_money(text: Column, currency: Column) -> Column:
    """Decimal string to minor units; null unless it has at most as many decimals as the currency."""
    e = exponent(currency)
    decimals = F.length(F.regexp_extract(text, r"^-?\d+\.(\d+)$", 1))
    scale = F.when(e == 0, 1).when(e == 3, 1000).otherwise(100)
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$") & (decimals <= e), (text.cast("decimal(30,9)") * scale).cast("long"))


def format_money(amount: Column, currency: Column) -> Column:
    e = exponent(currency)
    digits = F.abs(amount).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), e + 1), F.lit("0"))
    body = F.when(e == 0, digits).otherwise(F.concat(F.substring(digits, F.lit(1), F.length(digits) - e), F.lit("."), F.substring(digits, F.length(digits) - e + 1, e)))
    return F.concat(F.when(amount < 0, "-").otherwise(""), body)


def reporting_day(ts: Column, tz: str) -> Column:
    """The calendar day in ``tz`` of an instant given in UTC."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), tz))


def parse_instant(text: Column) -> Column:
    """``YYYY-MM-DD HH:mm:ss +HHMM`` to an instant; null for a blank or any other form."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [+-]\d{4}$")
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss xx")))


def day_bounds(day: Column, tz: str) -> tuple[Column, Column]:
    """First instant of a calendar day in ``tz``, and of the next."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), tz)
    return at(day), at(F.date_add(day, 1))


def native_day(day: Column, tz: str, reporting_tz: str) -> Column:
    """The reporting day of the middle of a calendar day in ``tz``."""
    a, b = day_bounds(day, tz)
    return reporting_day(F.timestamp_micros(F.floor((F.unix_micros(a) + F.unix_micros(b)) / 2)), reporting_tz)


def poisson_interval(n: Column, z: float) -> tuple[Column, Column]:
    s = F.sqrt(n + 0.375)
    low, high = F.greatest(F.greatest(F.lit(0.0), s - z / 2) ** 2, F.lit(0.01)), (s + z / 2) ** 2
    return F.when(n > 0, low), F.when(n > 0, high)


def shrunk(raw: Column, mean: Column, n: Column, k: Column) -> Column:
    w = ratio(n, n + k)
    return F.when(n + k <= 0, raw).otherwise(w * raw + (1 - w) * mean)


def verdict(low: Column, high: Column, target: float) -> Column:
    return F.when(low > target, "ABOVE_TARGET").when(high < target, "BELOW_TARGET").otherwise("NOT_DISTINGUISHABLE")


def query_value(url: Column, key: str) -> Column:
    """First value of a query parameter, decoded; works on relative and malformed addresses."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = F.regexp_extract(F.concat(F.lit("&"), q), rf"&{key}=([^&]*)", 1)
    found = F.concat(F.lit("&"), q).rlike(rf"&{key}=")
    return F.when(found, F.coalesce(F.try_url_decode(raw), raw))


def source_class(source: Column) -> Column:
    s = F.lower(F.trim(source))
    # Spellings that mean the ads platform.
    return F.when(s.isNull() | (s == ""), F.lit(None)).when(s.isin("meta", "roi_meta", "facebook", "rm_meta"), "meta").otherwise("other")


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of any length, 15 digits at a time; null if lengths differ or either is not hex."""
    ok = (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    number = lambda c, i: F.conv(F.substring(c, i, F.lit(15)), 16, 10).cast("long")
    add = lambda n, i: n + F.bit_count(number(a, i).bitwiseXOR(number(b, i)))
    return F.when(ok, F.aggregate(F.sequence(F.lit(1), F.length(a), F.lit(15)), F.lit(0), add))


def tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, blank ones dropped; null if none is left."""
    out = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(out) > 0, out)


def untrusted(text: Column) -> Column:
    """Text from outside between marks that it cannot close; null and empty texts are null."""
    safe = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(text != "", F.concat(F.lit("<untrusted>"), safe, F.lit("</untrusted>")))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def same_currency(amount: Column, currency: Column, wanted: str) -> Column:
    """``amount``, or an error if it is in another currency: there is no conversion."""
    return F.when(currency == wanted, amount).otherwise(F.raise_error(F.concat(F.lit("amount in another currency: "), F.coalesce(currency, F.lit("none")))).cast("long"))


def money_sum(amount: Column, currency: Column) -> Column:
    """Sum of amounts of a group, an error if they are in several currencies."""
    one = F.min(currency).eqNullSafe(F.max(currency))
    return F.when(one, F.sum(amount)).otherwise(F.raise_error(F.lit("amounts in several currencies")).cast("long"))
