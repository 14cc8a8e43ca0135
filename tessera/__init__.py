"""tessera: Spark-native analytics operators (profiling, cleaning, OLAP cubes,
pattern and graph mining, ML preparation and comparison, forecasting, text
extraction and stream mining).  Every operator takes and returns DataFrames."""

__version__ = "0.1.0"
