"""The checks that every silver and gold table declares, and one report over all of them."""

from pricemill.constants import CONVERTED_CURRENCIES, CURRENCIES, OHLC, PERIOD_KEYS
from pricemill.operators import quality
from pricemill.operators.quality import not_null, percentage, positive


def daily_checks():
    """Every price in every currency, the rates, the volume and RSI of the daily fact."""
    prices = [f"{m}_{c}" for c in CURRENCIES for m in OHLC]
    rates = [f"rate_usd_{c}" for c in CONVERTED_CURRENCIES]
    return [
        *[not_null(c) for c in ("date_prices", "close_usd", "volume")],
        *[positive(c) for c in (*prices, "volume", *rates)],
        percentage("rsi"),
    ]


def rate_checks():
    rates = [f"rate_usd_{c}" for c in CONVERTED_CURRENCIES]
    return [*[not_null(c) for c in ("date_rates", *rates)], *[positive(c) for c in rates]]


def period_checks(unit):
    """A gold table is checked in the base currency."""
    return [
        *[not_null(c) for c in (PERIOD_KEYS[unit], "close_usd", "dbt_batch_id")],
        *[positive(f"{m}_usd") for m in OHLC],
        percentage("rsi"),
    ]


def report(tables, series="series"):
    """Failing rows of each check of each table; ``tables`` as ``refresh`` returns them."""
    declared = {
        "daily": (daily_checks(), [series, "date_prices"]),
        "rates": (rate_checks(), ["date_rates"]),
    } | {unit: (period_checks(unit), [series, key]) for unit, key in PERIOD_KEYS.items()}
    return quality.report_tables(
        {name: (tables[name], *declared[name]) for name in declared if name in tables}
    )
