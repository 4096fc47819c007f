"""Block-transform sweeps, experiment-record analytics and corpus operators on Spark."""
