"""Dictionaries of torch tensors over an archive. Needs torch, which is imported by the calls only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from . import compat


def save_file(spark: SparkSession, tensors: Mapping[str, object], path: str) -> None:
    """Tensors on any device, with or without gradients; bfloat16 is stored as float32, which numpy has."""
    import torch

    plain = {k: v.detach().cpu() for k, v in tensors.items()}
    compat.save(spark, path, {k: (v.float() if v.dtype == torch.bfloat16 else v).contiguous().numpy() for k, v in plain.items()})


def load_file(spark: SparkSession, path: str, device: str = "cpu") -> dict[str, object]:
    import torch

    return {k: torch.from_numpy(v).to(device) for k, v in compat.load(spark, path).items()}
