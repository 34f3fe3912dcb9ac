"""The stages end to end: inputs to the tables the next stage reads."""
