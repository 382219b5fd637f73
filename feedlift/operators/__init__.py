"""DataFrame operators: use them with ``df.transform`` on batches and streams."""
