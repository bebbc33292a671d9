"""Counters of a store in this process, with the averages and rates that follow from them."""

from __future__ import annotations

from collections import Counter

NAMES = (
    "blocks_written", "blocks_read", "blocks_deleted", "wal_writes", "wal_flushes", "wal_recoveries", "sstable_reads", "sstable_writes", "compactions", "edges_added", "edges_removed",
    "total_write_time_ns", "total_read_time_ns", "total_wal_flush_time_ns", "write_errors", "read_errors", "wal_errors", "total_bytes_written", "total_bytes_read", "wal_bytes_written", "sstable_bytes_written",
    "memtable_memory_bytes", "compaction_queue_size",
)


class StorageMetrics:
    def __init__(self):
        self._n: Counter = Counter()

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            if name not in NAMES:
                raise KeyError(name)
            self._n[name] += n

    def __getitem__(self, name: str) -> int:
        return self._n[name]

    def _per(self, total: str, count: str, scale: float = 1) -> float:
        return self._n[total] * scale / self._n[count] if self._n[count] else 0

    def as_dict(self) -> dict:
        out: dict = {n: self._n[n] for n in NAMES}
        out["average_write_latency_ns"] = int(self._per("total_write_time_ns", "blocks_written"))
        out["average_read_latency_ns"] = int(self._per("total_read_time_ns", "blocks_read"))
        out["average_wal_flush_latency_ns"] = int(self._per("total_wal_flush_time_ns", "wal_flushes"))
        out["average_block_size_bytes"] = int(self._per("total_bytes_written", "blocks_written"))
        out["write_throughput_bps"] = self._per("total_bytes_written", "total_write_time_ns", 1e9)
        out["read_throughput_bps"] = self._per("total_bytes_read", "total_read_time_ns", 1e9)
        return out
