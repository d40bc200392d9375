"""Column functions: text cleaning, sentences, answer rules."""
