"""The flights table: its columns, value rules and checks, shared by the data-preparation queries."""

from __future__ import annotations

from pyspark.sql import types as T

# The 29 columns in order; all are int but the text ones named below.
COLUMNS = [
    "Year", "Month", "DayofMonth", "DayOfWeek", "DepTime", "CRSDepTime", "ArrTime", "CRSArrTime", "UniqueCarrier", "FlightNum",
    "TailNum", "ActualElapsedTime", "CRSElapsedTime", "AirTime", "ArrDelay", "DepDelay", "Origin", "Dest", "Distance", "TaxiIn",
    "TaxiOut", "Cancelled", "CancellationCode", "Diverted", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
]
TEXT = ["UniqueCarrier", "TailNum", "Origin", "Dest", "CancellationCode", "Diverted"]
TIMES = ["DepTime", "CRSDepTime", "ArrTime", "CRSArrTime"]
TAIL_NUMBER = r"^N[A-Z0-9]{2,5}$"
DELAY_LOW, DELAY_HIGH = -180, 2880

SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in TEXT else T.IntegerType()) for c in COLUMNS])
