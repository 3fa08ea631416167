"""contentlake: building and querying a catalogue of hash-identified records on Spark."""

__version__ = "0.1.0"
