from .study import Study, run_study

__all__ = ["Study", "run_study"]
