"""Part of tradewind."""
