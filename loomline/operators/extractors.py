"""Pluggable extractors: each gives rows of the timeline's shape; a registry runs and unions them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from loomline.session import materialize

from . import fusion, sequence

log = logging.getLogger(__name__)
Inputs = dict[str, DataFrame]


class Extractor(Protocol):
    name: str
    version: str
    event_types: tuple[str, ...]

    def is_available(self) -> bool: ...

    def extract(self, inputs: Inputs) -> DataFrame: ...


class StreamExtractor:
    """An extractor from a function of the inputs."""

    def __init__(self, name: str, function: Callable[[Inputs], DataFrame], event_types: tuple[str, ...] = (), version: str = "1.0", available: Callable[[], bool] = lambda: True) -> None:
        self.name, self.version, self.event_types, self._function, self._available = name, version, event_types, function, available

    def is_available(self) -> bool:
        return self._available()

    def extract(self, inputs: Inputs) -> DataFrame:
        return self._function(inputs)


class SceneExtractor(StreamExtractor):
    def __init__(self, threshold: float = 0.15) -> None:
        super().__init__("scene", lambda inputs: fusion.scene_events(sequence.scene_changes(inputs["frames"], threshold)), ("scene",))


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Extractor] = {}
        self._off: set[str] = set()

    def register(self, extractor: Extractor) -> None:
        self._known[extractor.name] = extractor

    def unregister(self, name: str) -> None:
        self._known.pop(name, None)
        self._off.discard(name)

    def enable(self, name: str, on: bool = True) -> None:
        if name not in self._known:
            raise KeyError(name)
        (self._off.discard if on else self._off.add)(name)

    def disable(self, name: str) -> None:
        self.enable(name, False)

    def names(self) -> list[str]:
        return list(self._known)

    def enabled(self) -> list[Extractor]:
        return [e for n, e in self._known.items() if n not in self._off and e.is_available()]

    def run_all(self, inputs: Inputs) -> DataFrame:
        """Union of all enabled extractors, ordered; one that fails, in planning or in its tasks, gives nothing and is logged.

        Each extractor runs on its own and keeps its rows in the shared folder, so a failing task ends only its own extractor.
        """
        parts = []
        for extractor in self.enabled():
            try:
                parts.append(materialize(extractor.extract(inputs).select(*fusion.TIMELINE)))
            except (PySparkException, Py4JJavaError, KeyError, ValueError) as problem:
                log.warning("extractor %s failed: %s", extractor.name, str(problem).split("\n")[0])
        if not parts:
            raise ValueError("no extractor gave a result")
        return fusion.order_timeline(fusion.fuse(*parts))
