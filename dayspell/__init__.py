"""dayspell: climate-extremes analysis of daily observations on Spark.

Every operator takes and returns DataFrames over long tables of
(place, day, value) and is lazy; nothing is collected to the driver.
"""

__version__ = "0.1.0"
