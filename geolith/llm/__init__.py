"""Training-data operators: ten independent building blocks over document tables."""
