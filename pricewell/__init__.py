"""Price analytics on Spark tables: cleansing, quality gates, signals, source comparison, should-cost."""
