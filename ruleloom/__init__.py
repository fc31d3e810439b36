"""Business and validation rules as Spark columns and DataFrame plans."""
