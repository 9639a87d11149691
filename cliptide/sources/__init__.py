from .adapters import view
from .tables import load, shared_dir, stage, staging

__all__ = ["load", "shared_dir", "stage", "staging", "view"]
