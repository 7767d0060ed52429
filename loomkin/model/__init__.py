"""The thin models that stay on the driver, and their use over DataFrames."""
