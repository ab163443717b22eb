"""A relation-algebra and business-rule engine on Spark DataFrames."""
