"""Point-in-time analytics on PySpark: bars, corporate actions, news, models, backtests."""
