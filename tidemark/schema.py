"""Column names that the operators share. Every table of bars is keyed by symbol and date."""

PRICES = ("open", "high", "low", "close")
BAR = ("symbol", "date", *PRICES, "volume")
FEATURES = ("return_1d", "return_5d", "volatility_5d", "volatility_20d", "intraday_range", "sma_ratio_5_20", "rsi_14", "volume_zscore_20")
TARGET = "target_volatility_5d"
LABEL = "target_high_volatility"
#: Periods in a year, by which volatility is annualised.
PERIODS = 252
