"""Registers the query of every corpus operator."""

from importlib import import_module

MODULES = ("toxicity", "licenses", "wordpiece", "bpe", "interpolation", "url_rules", "contamination", "quality", "line_chunks", "near_copies", "exact_copies", "whitening", "divergence")


def load() -> None:
    for module in MODULES:
        import_module(f"keelson.llm.{module}")
