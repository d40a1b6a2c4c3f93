"""Evidence-grounded analytics over collections of records, as DataFrame operations of Spark."""
