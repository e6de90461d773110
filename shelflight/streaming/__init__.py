"""Row-local stages over a stream of inventory lines."""
