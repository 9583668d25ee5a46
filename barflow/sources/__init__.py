"""Readers and writers: ticks, bars, quotes, company dimension, sinks."""
