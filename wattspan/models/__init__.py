"""Scaling, Isolation Forest, nearest neighbours, Local Outlier Factor, registry, scoring."""
