"""Column functions: names, responses, errors, texts of requests and progress."""
