"""Session settings by input size."""

import math

PARTITION_BYTES = 256 * 1024 * 1024


def settings_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a session that reads ``input_bytes`` on ``cores`` cores.

    Shuffles start with enough partitions for the whole input and are merged at run time when less
    arrives. Skewed join partitions are split, and checkpoints are removed with the tables that
    used them. ``spark.checkpoint.dir`` must name a folder that the whole cluster shares.
    """
    parts = str(max(2 * cores, min(100_000, math.ceil(input_bytes / PARTITION_BYTES))))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.shuffle.partitions": parts,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
    }
