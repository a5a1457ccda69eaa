"""Boosted trees with folds, bagging and stacking, trained on the cluster."""
