"""Training-data operators over the ``documents`` and ``pages`` tables."""
