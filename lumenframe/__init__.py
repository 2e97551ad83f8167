"""lumenframe: multichannel time-series and imaging analytics on Spark DataFrames."""
