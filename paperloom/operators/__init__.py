"""DataFrame operators: retrieval, answer combination, sampling, metrics, exam text."""
