"""Table jobs: pure functions from DataFrames to DataFrames, every table keyed by ``contract_id``."""
