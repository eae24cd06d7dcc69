"""Registration of queries next to the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from playbill.catalog.bindings import Data


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable:
        """Register a query over :class:`Data`; without SQL only its rows are checked."""

        def register(function: Callable) -> Callable:
            self.queries[name] = lambda spark, folder: function(Data(spark, folder))
            if oracle is not None:
                self.oracles[name] = oracle
            return function

        return register
