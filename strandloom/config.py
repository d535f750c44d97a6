"""Parameters of an assembly, with their checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AssemblyConfig:
    """``k`` is the k-mer length, ``minimizer`` the l-mer length below it.

    ``buckets`` is the width of the count histogram and ``node_limit`` the number
    of nodes at which contraction stops; 0 means the default for both.
    ``read_length`` and ``batch`` only size the input of other engines; they are
    checked and have no effect here.
    """

    k: int = 32
    minimizer: int = 8
    coverage: int = 1
    read_length: int = 100
    buckets: int = 21
    node_limit: int | None = 100_000
    batch: int = 100_000_000
    min_contig: int = 400
    alphabet: str = "strict"
    walk: str = "reference"
    owners: int = 16

    def __post_init__(self):
        if self.k <= 0:
            object.__setattr__(self, "k", 32)
        if not self.buckets:
            object.__setattr__(self, "buckets", 21)
        if self.k > 64:
            raise ValueError("k must not exceed 64")
        if not 0 < self.minimizer < self.k:
            raise ValueError("the minimizer must be shorter than k")
        if self.coverage == 0:
            raise ValueError("coverage must not be 0")
        if not 100 <= self.read_length <= 250:
            raise ValueError("read length must be 100 to 250")
        if self.alphabet not in ("strict", "compat"):
            raise ValueError("alphabet must be strict or compat")
        if self.walk not in ("reference", "full_flow"):
            raise ValueError("walk must be reference or full_flow")

    @property
    def node(self) -> int:
        """Length of a node's key."""
        return self.k - 1


def parse_arguments(arguments: list[str]) -> tuple[str, AssemblyConfig]:
    """Path and parameters from flags -f -b -r -c -t -n; unknown flags are an error."""
    import argparse

    p = argparse.ArgumentParser(prog="strandloom", allow_abbrev=False)
    p.add_argument("-f", dest="path", required=True)
    p.add_argument("-b", dest="batch", type=int, default=100_000_000)
    p.add_argument("-r", dest="read_length", type=int, required=True)
    p.add_argument("-c", dest="coverage", type=int, required=True)
    p.add_argument("-t", dest="buckets", type=int, default=21)
    p.add_argument("-n", dest="node_limit", type=int, default=100_000)
    p.add_argument("-k", dest="k", type=int, default=32)
    found = vars(p.parse_args(arguments))
    path = found.pop("path")
    found["node_limit"] = found["node_limit"] or 100_000
    return path, AssemblyConfig(**found)
