"""Where the operators put tables and files that all executors read."""

from sensorgrid.storage import checkpoint_dir, stored

__all__ = ["checkpoint_dir", "stored"]
