"""The operators bound to the tables of the driver, with their SQL."""
