"""Names that results show in place of what a row lacks."""

ETH_TRANSFER = "<ETH transfer>"
UNKNOWN_CHAIN, UNKNOWN_CURRENCY = "Unknown", "???"
