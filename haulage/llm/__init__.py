"""Training-data operators: line dedup, near-dedup, quality, language,
secrets, decontamination, packing, WARC, chat formatting, licences.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
