"""Building blocks that cut lineage, loop, rank and sum across partitions."""

from graphloom.plans.components import connected_components
from graphloom.plans.prefix import running_total
from graphloom.plans.shared import drop_saved, fresh_path, save, shared_dir, ship, shuffle_partitions

__all__ = ["connected_components", "drop_saved", "fresh_path", "running_total", "save", "shared_dir", "ship", "shuffle_partitions"]
