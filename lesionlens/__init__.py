"""Spark-native analytics for evaluating segmentation models over voxel, case and score tables."""

__version__ = "0.1.0"
