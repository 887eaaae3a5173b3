"""gneiss: a Spark-native engine for carving records out of damaged block images and auditing the result.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function, so the same code serves
raw images (through the block source) and ordinary Parquet tables.
"""
