"""Training-data operators: near-dedup, licence scans, search, chat formatting, BPE, HTML, quality, mixing."""
