"""rangelake: locate, extract, index and validate records inside raw JSON text with Spark DataFrames."""
