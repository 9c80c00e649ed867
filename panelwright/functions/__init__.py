"""Element-wise functions with defined null behaviour."""
