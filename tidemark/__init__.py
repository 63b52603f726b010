"""Analytics over source text, its history and its labels, as lazy DataFrame operators."""
