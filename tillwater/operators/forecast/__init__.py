"""Daily sales forecasts per series: history, model, rolling evaluation."""
