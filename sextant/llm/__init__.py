"""Training-data operators (language id, quality, WARC, decontamination, dedup,
tokenisation, top-k search).  Nothing else in the package imports this one."""
