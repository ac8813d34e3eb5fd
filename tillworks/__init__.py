"""Store analytics on Spark: reports, bulk change application, checkout, stock
ledgers and integrity checks over the tables of an online shop.

Every operator takes DataFrames and returns a DataFrame (or a small dict of
them); nothing is collected to the driver except scalars and bounded counts.
"""
