"""Column builders; none of them runs Python on the executors."""
