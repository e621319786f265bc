"""Fixed values of the data model: names, thresholds and limits that results depend on."""

# Measure and currency names, in table column order.
OHLC = ("low", "high", "open", "close")
INDICATORS = (
    "macd", "macd_signal", "macd_hist",
    "sma_7", "sma_50", "sma_200",
    "ema_7", "ema_50", "ema_200",
)
MEASURES = OHLC + INDICATORS
CURRENCIES = ("usd", "chf", "eur")
CONVERTED_CURRENCIES = ("chf", "eur")

# Indicator payload field -> silver column.
INDICATOR_COLUMNS = {
    "macd": "macd",
    "macdsignal": "macd_signal",
    "macdhist": "macd_hist",
    "sma7": "sma_7",
    "sma50": "sma_50",
    "sma200": "sma_200",
    "ema7": "ema_7",
    "ema50": "ema_50",
    "ema200": "ema_200",
}

# Indicator groups offered to a chart.
INDICATOR_GROUPS = {
    "rsi": ("rsi",),
    "macd": ("macd", "macd_signal", "macd_hist"),
    "sma": ("sma_7", "sma_50", "sma_200"),
    "ema": ("ema_7", "ema_50", "ema_200"),
}

# Relative strength index.
RSI_PERIOD = 14
RSI_OVERSOLD = 30
RSI_OVERBOUGHT = 70
RSI_DEFAULT = 50

# Moving average spans; 12/26/9 is the textbook MACD.
AVERAGE_SPANS = (7, 50, 200)
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9

# Loading.
CANDLE_WINDOW_DAYS = 200
CANDLE_HISTORY_DAYS = 365 * 13
FX_WINDOW_DAYS = 365
FX_HISTORY_START = "2010-01-01"
FX_BASE = "USD"
FX_QUOTES = ("EUR", "CHF")
LOOKBACK_DAYS = 10
CONFIGURED_PAIRS = (
    ("BTC", "USD"),
    ("AAVE", "USD"),
    ("ETH", "USD"),
    ("ETH", "BTC"),
    ("USD", "EUR"),
    ("USD", "CHF"),
)
CALENDAR_START = "2009-12-31"
SCHEMA_PREFIX = "dlh_"

# Serving.
MONTHLY_HISTORY_DAYS = 1800
AGGREGATED_PERIODS = 12
FORECAST_DATES = 365
RESULT_ROW_CAP = 10_000
DAYS_PER_FILTER = {"1w": 7, "1m": 30, "6m": 180, "1y": 365, "all": 3650}
DEFAULT_FILTER_DAYS = 180
SLICE_ROWS = {"1w": 7, "1m": 30, "6m": 180, "1y": 365, "ytd": 365}
DEFAULT_SLICE_ROWS = 180
SMOOTHING_SPAN_DAYS = 2 * 365
SMOOTHING_DAY_OF_MONTH = 15
BAD_LOW_DATE = "2017-04-01"
BAD_LOW_LIMIT = 100
PERIOD_UNITS = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}
REQUEST_TYPES = ("metrics", "history", "aggregated", "forecast")

# Period -> key column, finest first.
PERIOD_KEYS = {
    "week": "iso_week_start_date",
    "month": "month_start_date",
    "quarter": "quarter_start_date",
    "year": "year_start_date",
}
