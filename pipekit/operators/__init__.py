"""DataFrame-to-DataFrame operators.  All are lazy unless their docstring says that they run a job."""
