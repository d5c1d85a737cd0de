"""Retrieval-evaluation analytics expressed as Spark DataFrame and SQL plans."""

__version__ = "0.1.0"

_LAZY = {"evaluate": "evaluation", "per_query": "evaluation", "report": "evaluation", "confidence": "evaluation", "make_scorer": "scorers", "REGISTRY": "scorers", "Scorer": "scorers", "build_session": "session"}

__all__ = sorted(_LAZY)


def __getattr__(name: str):
    if name in _LAZY:
        from importlib import import_module

        return getattr(import_module(f".{_LAZY[name]}", __name__), name)
    raise AttributeError(name)
