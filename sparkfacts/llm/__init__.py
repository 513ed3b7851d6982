"""Training-data operators over whole corpora. Nothing outside this subpackage imports it."""
