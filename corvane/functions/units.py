"""Conversion of units of time, data, rate and frequency. Names are case-sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimension and size of each unit; bits count as eighths of bytes, KB is 1000 and KiB 1024 bytes.
UNITS: dict[str, tuple[str, float]] = {
    "ns": ("time", 1e-09), "us": ("time", 1e-06), "µs": ("time", 1e-06), "ms": ("time", 0.001), "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0),
    "bit": ("data", 0.125), "B": ("data", 1.0), "KB": ("data", 1000.0), "KiB": ("data", 1024.0), "MB": ("data", 1000000.0), "MiB": ("data", 1048576.0), "GB": ("data", 1000000000.0), "GiB": ("data", 1073741824.0), "TB": ("data", 1000000000000.0), "TiB": ("data", 1099511627776.0),
    "bps": ("rate", 0.125), "B/s": ("rate", 1.0), "Kbps": ("rate", 125.0), "KB/s": ("rate", 1000.0), "KiB/s": ("rate", 1024.0), "Mbps": ("rate", 125000.0), "MB/s": ("rate", 1000000.0), "MiB/s": ("rate", 1048576.0), "Gbps": ("rate", 125000000.0), "GB/s": ("rate", 1000000000.0), "GiB/s": ("rate", 1073741824.0),
    "Hz": ("frequency", 1.0), "kHz": ("frequency", 1000.0), "MHz": ("frequency", 1000000.0), "GHz": ("frequency", 1000000000.0),
}


def converted(value: Column, source: str, target: str) -> Column:
    """The value in another unit of the same dimension."""
    (a, x), (b, y) = UNITS[source], UNITS[target]
    if a != b:
        raise ValueError(f"{source} and {target} measure different things")
    return value * F.lit(x) / F.lit(y)


def converted_rows(value: Column, source: Column, target: Column) -> Column:
    """As converted(), with the units in columns; null for unknown units and for different dimensions."""
    size = F.create_map(*(F.lit(v) for name, (_, n) in UNITS.items() for v in (name, n)))
    kind = F.create_map(*(F.lit(v) for name, (k, _) in UNITS.items() for v in (name, k)))
    at = lambda m, c: F.try_element_at(m, c)
    return F.when(at(kind, source) == at(kind, target), value * at(size, source) / at(size, target))


def transfer_seconds(size: Column, size_unit: str, bandwidth: Column, bandwidth_unit: str, efficiency: float = 1.0) -> Column:
    """Seconds to move ``size`` at an effective share of ``bandwidth``; null for negative sizes and no bandwidth."""
    (a, x), (b, y) = UNITS[size_unit], UNITS[bandwidth_unit]
    if (a, b) != ("data", "rate") or not 0 < efficiency <= 1:
        raise ValueError("an amount of data, a rate, and an efficiency above 0 and at most 1")
    return F.when((size >= 0) & (bandwidth > 0), size * F.lit(x) / (bandwidth * F.lit(y) * F.lit(efficiency)))
