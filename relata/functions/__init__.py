"""Text forms of predicates and arithmetic, as Spark column expressions."""
