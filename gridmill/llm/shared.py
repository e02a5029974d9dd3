"""The folder that driver and executors share."""

from gridmill.checkpoints import ensure_checkpoint_dir, release, saved

__all__ = ["ensure_checkpoint_dir", "release", "saved"]
