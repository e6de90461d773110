"""Reading inventory data and publishing results."""
