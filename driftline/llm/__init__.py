"""Operators for training-data pipelines. `queries.QUERIES` and `queries.ORACLES` hold their registered queries."""
