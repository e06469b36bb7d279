"""PySpark-native engine for genotype-to-phenotype screening data."""
