"""Training-data operators: license scan, quality rules, language id, packing, near-duplicates, chat
formatting, n-gram language model, WARC bundles and source mixing. Nothing outside this folder imports it."""
