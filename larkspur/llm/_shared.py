"""Scratch tables in the folder that all executors share."""

from ..scratch import drop_scratch, materialise, scratch_path, shared_dir

__all__ = ["drop_scratch", "materialise", "scratch_path", "shared_dir"]
