"""Subscriber analytics on Spark: period features, device history, encoders, boosted-tree
training and date correction, all as DataFrame plans."""
