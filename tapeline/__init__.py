"""tapeline - market-data and company-filings analytics as Spark jobs.

Every operator takes DataFrames and returns a lazy DataFrame over all symbols
at once; nothing here collects data or loops over symbols on the driver.
"""
