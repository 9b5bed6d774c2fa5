"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass, field

from tesselkv.errors import BadConfig, InvalidEncryptionKey, ThresholdZero
from tesselkv.plans.levels import LevelConfig

MIB = 1 << 20


@dataclass(frozen=True)
class Config:
    """Sizes in bytes, times in seconds."""

    read_only: bool = False
    num_versions_to_keep: int = 1
    namespace_offset: int | None = None
    detect_conflicts: bool = True
    managed_txns: bool = False
    value_threshold: int = MIB
    value_percentile: float = 0.0
    vlog_file_size: int = 512 * MIB
    vlog_max_entries: int = 1_000_000
    compression: int = 2
    bloom: bool = True
    encryption_key: bytes = b""
    key_rotation: int = 10 * 86_400
    output_rows: int = 5_000_000
    lease: int = 60  # a lock whose process has not renewed it for so long is dead
    file_retention: int = 600  # replaced files stay so long, for scans without a transaction
    log_commits: int = 1000  # a flush is due at so many commits, or at a memtable's bytes
    levels: LevelConfig = field(default_factory=LevelConfig)

    @property
    def max_batch_size(self) -> int:
        return self.levels.memtable_size * 15 // 100

    @property
    def max_batch_count(self) -> int:
        return self.max_batch_size // 96

    def checked(self) -> Config:
        if not MIB <= self.vlog_file_size < 2048 * MIB:
            raise BadConfig("vlog_file_size lies between 1 MiB and 2 GiB")
        if self.lease < 1 or self.file_retention < 0 or self.vlog_max_entries < 1:
            raise BadConfig("lease, file_retention and vlog_max_entries are positive")
        if self.num_versions_to_keep < 1 or self.output_rows < 1:
            raise BadConfig("at least one version and one row a table are kept")
        if self.compression not in (0, 1, 2):
            raise BadConfig("compression is 0 (none), 1 (snappy) or 2 (zstd)")
        if not 0 <= self.value_percentile <= 1:
            raise BadConfig("value_percentile is a share from 0 to 1")
        if self.value_threshold <= 0:
            raise ThresholdZero("value_threshold is positive")
        if self.value_threshold > min(MIB, self.max_batch_size):
            raise BadConfig("value_threshold is 1 MiB and the batch size at most")
        if len(self.encryption_key) not in (0, 16, 32):
            raise InvalidEncryptionKey("16 or 32 bytes, or none")
        return self
