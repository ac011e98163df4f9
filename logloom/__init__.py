"""Log-template analytics on Spark: mask, tokenize, mine, match, extract, merge, evaluate."""
