"""Operators for preparing language-model training data, one module per method.

``queries`` registers them over the ``documents``, ``pages``, ``embeddings``, ``benchmark`` and ``labels`` tables.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
