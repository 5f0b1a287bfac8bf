"""Column expressions: time, text and robust statistics. No I/O, no actions."""
