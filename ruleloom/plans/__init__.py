"""Sets of rules over DataFrames."""
