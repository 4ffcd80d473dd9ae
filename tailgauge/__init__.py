"""One-day Value-at-Risk analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames in long form: one table holds all
tickers, all portfolios or all models, keyed by ``ticker`` / ``series_id`` /
``method`` and a session ``date``.  (key, date) is unique in every table past
ingestion, so the rows of one key are bounded by the number of calendar days.
"""
