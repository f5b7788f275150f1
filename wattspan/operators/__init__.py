"""DataFrame operators: ordering, windows, filters, resampling, profiling, joins."""
