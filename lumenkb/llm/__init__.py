"""Training-data operators: thirteen independent DataFrame-to-DataFrame functions and their queries."""
