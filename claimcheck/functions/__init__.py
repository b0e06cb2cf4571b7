"""Column functions: text, dates, geometry and the fixed word lists behind them."""
