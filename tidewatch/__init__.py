"""Event workflow analytics on Spark: change detection, triggers, chat
commands, run outcomes, snapshot diffs, logs, transfers and scoped values,
each as a function from DataFrames to DataFrames."""

__version__ = "0.1.0"
