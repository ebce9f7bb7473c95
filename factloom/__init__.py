"""factloom: a PySpark engine for conversation knowledge and corpus preparation."""
