"""A PySpark-native analytics engine for livestock SNP genotypes."""
