"""Media-effectiveness analytics as Spark DataFrame operators.

A panel is a DataFrame with one row per (``geo``, ``week``): spend and
impressions per channel, revenue, conversions, promotion text and controls.
Every operator takes and returns DataFrames; the regression works on sufficient
statistics gathered in one distributed pass.
"""

__version__ = "0.1.0"
