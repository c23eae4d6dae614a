"""Concept extraction, linking and evaluation as Spark plans."""

__all__ = ["Pipeline", "PipelineConfig"]


def __getattr__(name: str):
    if name in __all__:
        from mentionlake.plans import pipeline

        return getattr(pipeline, name)
    raise AttributeError(name)
