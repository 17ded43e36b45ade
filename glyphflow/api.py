"""The library for single texts, without a session: what the Column functions do for columns."""

from __future__ import annotations

import functools
from typing import NamedTuple

import pyarrow as pa

from glyphflow.functions.conversion import Converter
from glyphflow.functions.detection import SAMPLE_BYTES, Detector
from glyphflow.plans.configs import CONFIGS, REGIONS, config_for
from glyphflow.sources.dictionaries import Registry

__all__ = ["Converter", "Detection", "Registry", "config_for", "configs", "convert", "convert_region", "convert_with_custom", "detect", "detect_bytes", "regions"]


class Detection(NamedTuple):
    region: str
    confidence: int


def configs() -> list[str]:
    return list(CONFIGS)


def regions() -> list[str]:
    return list(REGIONS)


def convert(text: str, config: str, registry: Registry | None = None) -> str:
    return Converter(config, registry=registry).convert(text)


def convert_region(text: str, source: str, target: str, registry: Registry | None = None) -> str:
    return Converter.for_region(source, target, registry=registry).convert(text)


def convert_with_custom(text: str, config: str, entries, registry: Registry | None = None) -> str:
    return Converter(config, custom=entries, registry=registry).convert(text)


@functools.lru_cache(maxsize=8)
def _detector(registry: Registry | None) -> Detector:
    return Detector(registry)


def detect(text: str, registry: Registry | None = None) -> Detection | None:
    """The whole text's region; None without Han characters and kana."""
    found = _detector(registry).detect(pa.array([text], pa.string()))[0].as_py()
    return found and Detection(**found)


def detect_bytes(content: bytes, registry: Registry | None = None) -> Detection | None:
    """The region of at most 4096 bytes, cut back to whole characters; None if the content isn't UTF-8."""
    try:
        content.decode()
    except UnicodeDecodeError:
        return None
    return detect(content[:SAMPLE_BYTES].decode("utf-8", "ignore"), registry)
