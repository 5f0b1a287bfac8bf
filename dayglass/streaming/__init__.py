"""The same features and scores from logs that keep arriving."""
