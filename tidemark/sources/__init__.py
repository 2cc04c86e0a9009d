"""Text formats of points, read and written as DataFrames, and tables of measurements.

A point: measurement, time, time_ns, tags (map), fields (map to type and value).
"""
