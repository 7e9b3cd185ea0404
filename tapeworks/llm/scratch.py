"""Tables that cut lineage: see tapeworks.shared."""

from tapeworks.shared import Scratch, bounded_batches, shared_dir

__all__ = ["Scratch", "bounded_batches", "shared_dir"]
