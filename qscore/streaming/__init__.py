"""Streams: the same detectors and scores on data as it arrives."""
