"""Column functions: cleaning, decoding by period, labels and measures of one row."""
